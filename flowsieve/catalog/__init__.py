"""The registered queries and the SQL that checks them."""

from flowsieve.catalog import all_columns, detect, evaluate, prepare, respond, small_fits, split_paths, stored

SECTIONS = (prepare, detect, respond, evaluate, small_fits, split_paths, all_columns, stored)


def queries() -> dict:
    return {name: f for section in SECTIONS for name, f in section.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for section in SECTIONS for name, text in section.SQL.items()}
