"""Queries of this subpackage and, where SQL can say them, their DuckDB SQL."""

from . import chat, collocations, contextmix, decontaminate, linededup, lloyd, mix, neardup, quality, secrets, sql, substrings, tokencount, warc

QUERIES = {
    "op1_linededup": linededup.op1_linededup,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_mix": mix.op3_mix,
    "op4_substrings": substrings.op4_substrings,
    "op5_contextmix": contextmix.op5_contextmix,
    "op6_warc": warc.op6_warc,
    "op7_chat": chat.op7_chat,
    "op8_neardup": neardup.op8_neardup,
    "op9_quality": quality.op9_quality,
    "op10_tokencount": tokencount.op10_tokencount,
    "op11_collocations": collocations.op11_collocations,
    "op12_secrets": secrets.op12_secrets,
    "op13_lloyd": lloyd.op13_lloyd,
}

ORACLE_SQL = sql.ORACLE_SQL
