"""Analytics over bilingual, code-switched dialogue on Spark DataFrames."""
