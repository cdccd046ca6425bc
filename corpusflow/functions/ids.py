"""Stable identifiers of documents, pages, chunks and tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def document_id(path: Column) -> Column:
    return F.substring(F.sha1(path), 1, 16)


def chunk_id(document: Column, page: Column, index: Column) -> Column:
    return F.format_string("%s_p%04d_c%04d", F.substring(document, 1, 8), page, index)


def page_id(document: Column, page: Column) -> Column:
    return F.format_string("%s_page_%04d", F.substring(document, 1, 8), page)


def table_id(document: Column, page: Column, index: Column) -> Column:
    return F.format_string("%s_p%04d_t%02d", F.substring(document, 1, 8), page, index)
