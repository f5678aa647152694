"""The operators' queries by name, with DuckDB SQL where it can express them."""

from __future__ import annotations

from . import bagminhash, decontaminate, extract, langid, lm, mixing, quality, rans, tokencount, warc

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_attention": lm.op2_attention,
    "op3_langid": langid.op3_langid,
    "op4_rans": rans.op4_rans,
    "op5_warc": warc.op5_warc,
    "op6_mixing": mixing.op6_mixing,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_extract": extract.op8_extract,
    "op9_bagminhash": bagminhash.op9_bagminhash,
    "op10_token_counts": tokencount.op10_token_counts,
}
ORACLE_SQL = {
    "op5_warc": warc.ORACLE,
    "op6_mixing": mixing.ORACLE,
}
