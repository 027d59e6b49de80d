"""All queries of this subpackage, and the SQL for those that SQL can express."""

from . import bpe, exact_dedup, hilbert, inverted, parsing, preference, resample, secrets, simhash, warc

MODULES = (bpe, exact_dedup, hilbert, inverted, parsing, preference, resample, secrets, simhash, warc)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in MODULES for k, s in m.SQL.items()}
