"""The queries of the redaction-leakage operators and their SQL; plan modules add theirs here."""

from . import anchoring, binary, dictionary, evaluation, flagship, measuring, signals, spatial

MODULES: list = [flagship, spatial, dictionary, measuring, evaluation, signals, binary, anchoring]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in MODULES for k, s in m.ORACLE_SQL.items()}
