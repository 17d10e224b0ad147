"""The registered queries of the training-data operators and their oracles."""

from __future__ import annotations

from .common import table
from .decontam import op5_decontamination
from .langid import op9_language
from .licenses import OP10_SQL, op10_licenses
from .neardup import op6_near_duplicates
from .ngramjoin import op3_ngram_join
from .packing import op4_pack
from .pii import op1_pii
from .runs import op12_periodic_runs
from .substrings import op11_substrings
from .tokens import op7_token_table
from .toxicity import op2_toxicity
from .veccodes import OP13_SQL, op13_vector_codes
from .warc import OP8_SQL, op8_warc


def queries() -> dict:
    return {
        "op1_pii": lambda spark, d: op1_pii(spark, table(spark, d, "documents")),
        "op10_licenses": lambda spark, d: op10_licenses(spark, table(spark, d, "documents")),
        "op2_toxicity": lambda spark, d: op2_toxicity(spark, table(spark, d, "documents"), table(spark, d, "labels")),
        "op3_ngram_join": lambda spark, d: op3_ngram_join(spark, table(spark, d, "documents")),
        "op4_packing": lambda spark, d: op4_pack(spark, table(spark, d, "documents")),
        "op5_decontamination": lambda spark, d: op5_decontamination(spark, table(spark, d, "documents"), table(spark, d, "benchmark")),
        "op6_near_duplicates": lambda spark, d: op6_near_duplicates(spark, table(spark, d, "embeddings")),
        "op7_token_ids": lambda spark, d: op7_token_table(spark, table(spark, d, "documents")),
        "op9_language": lambda spark, d: op9_language(spark, table(spark, d, "documents")),
        "op11_substrings": lambda spark, d: op11_substrings(spark, table(spark, d, "documents")),
        "op12_periodic_runs": lambda spark, d: op12_periodic_runs(spark, table(spark, d, "documents")),
        "op13_vector_codes": lambda spark, d: op13_vector_codes(spark, table(spark, d, "embeddings")),
        "op8_warc": lambda spark, d: op8_warc(spark, table(spark, d, "pages")),
    }


def oracle_sql() -> dict:
    return {"op8_warc": OP8_SQL, "op10_licenses": OP10_SQL, "op13_vector_codes": OP13_SQL}
