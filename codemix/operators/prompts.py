"""Prompt texts; `{topic}`, `{topics}` and `{n}` are filled per row."""

# The prompt of each strategy that has one, by strategy number.
STRATEGY_PROMPTS = {
    6: """Generate a conversation about {topic} in ENGLISH ONLY.

IMPORTANT: This is a monolingual English conversation. NO Spanish words at all.
Write natural, fluent English dialogue.

Format:
Speaker A: [English only]
Speaker B: [English only]

Write 10-12 lines about {topic}:""",
    7: """Genera una conversación sobre {topic} SOLAMENTE EN ESPAÑOL.

IMPORTANTE: Conversación monolingüe en español. NO palabras en inglés.
Escribe diálogo natural y fluido en español.

Formato:
Speaker A: [Solo español]
Speaker B: [Solo español]

Escribe 10-12 líneas sobre {topic}:""",
    8: """Generate a mostly English conversation about {topic}.

Include only 1-2 SMALL Spanish words/phrases in the ENTIRE conversation.
Tag the few Spanish words with <ES></ES>.

Example (notice very minimal Spanish):
Speaker A: How was your day?
Speaker B: Pretty good, just got back from the store.
Speaker A: What did you buy?
Speaker B: Just some groceries for dinner.
Speaker A: Sounds good, <ES>gracias</ES> for picking that up.
Speaker B: No problem!

Generate 10-12 lines:""",
}

# The prompt of a batch of monolingual dialogues, by language.
BATCH_PROMPTS = {
    "english": """Generate {n} separate English-only conversations on these topics:

{topics}

CRITICAL RULES:
- ENGLISH ONLY - absolutely no Spanish words
- Each conversation should be 8-10 lines
- Natural, casual dialogue
- Use format: "Speaker A:" and "Speaker B:"
- Clearly separate each conversation with "---CONVERSATION N---" (where N is the conversation number)

Now generate all {n} conversations:""",
    "spanish": """Genera {n} conversaciones separadas SOLO EN ESPAÑOL sobre estos temas:

{topics}

REGLAS:
- SOLO ESPAÑOL - ninguna palabra en inglés
- Cada conversación: 8-10 líneas
- Formato: "Speaker A:" y "Speaker B:"
- Separa con "---CONVERSACIÓN N---" (donde N es el número)

Genera las {n} conversaciones:""",
}
