"""All queries of the site operators, and their SQL."""

from . import audits, captures, cells, certificates, crawling, feeds, grammars, languages, pages, relations, sites, stores, texts

MODULES = (pages, relations, captures, certificates, crawling, feeds, grammars, texts, sites, stores, languages, certificates, crawling, audits, feeds, cells)
QUERIES = {name: q for m in MODULES for name, q in m.QUERIES.items()}
SQL = {name: s for m in MODULES for name, s in m.SQL.items()}
