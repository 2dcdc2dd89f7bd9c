"""The training-data queries by name, and their SQL where SQL can express them."""

from __future__ import annotations

from quarry.llm import chat_format, collocations, decontaminate, gif, html_text, language_id, mixing, near_duplicates, quality, repeats, secrets, token_records, whitening

QUERIES = {
    "op8_repeats": repeats.query,
    "op5_near_duplicates": near_duplicates.query,
    "op4_quality": quality.query,
    "op6_html_text": html_text.query,
    "op7_gif_media": gif.query,
    "op1_decontaminate": decontaminate.query,
    "op9_secrets": secrets.query,
    "op2_token_records": token_records.query,
    "op3_mix_sources": mixing.query,
    "op10_chat_format": chat_format.query,
    "op11_language_id": language_id.query,
    "op12_collocations": collocations.query,
    "op13_whitening": whitening.query,
}
ORACLES = {
    "op1_decontaminate": decontaminate.SQL,
    "op10_chat_format": chat_format.SQL,
    "op12_collocations": collocations.SQL,
}
