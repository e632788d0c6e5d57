"""Portolan: border-entry and city-demographics tables as Spark jobs.

Raw entry records, a code-label text and a demographics file go in; two fact
tables and six shared dimensions come out, with quality gates and the usual
star-schema questions on top. Everything is DataFrame expressions: no Python
runs per row.
"""
