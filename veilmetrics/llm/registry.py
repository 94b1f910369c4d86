"""The queries of this subpackage and their SQL."""

from . import decontamination, language, minhash, mixing, quality, secrets, sharding, simhash, sketches, spelling, substrings, token_store, vector_codes

MODULES = [secrets, decontamination, sharding, token_store, simhash, quality, language, mixing, sketches, substrings, spelling, vector_codes, minhash]


def queries() -> dict:
    return {k: getattr(m, k) for m in MODULES for k in vars(m) if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict:
    return {k: v for m in MODULES for k, v in getattr(m, "ORACLE_SQL", {}).items()}
