"""Readers, writers and the views the checks run on."""
