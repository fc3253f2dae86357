"""The registered queries of the engine, each with the SQL that says the same."""

from . import evaluation, files, ingestion, media, planning, sources, streams

BOOKS = (evaluation.book, planning.book, files.book, ingestion.book, media.book, sources.book, streams.book)


def queries() -> dict:
    return {name: query for book in BOOKS for name, query in book.queries.items()}


def oracle_sql() -> dict:
    return {name: sql for book in BOOKS for name, sql in book.sql.items()}
