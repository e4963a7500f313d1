"""Paths of names that start with any character, against the query's SQL."""

import duckdb

from lodestone import catalogue_records
from lodestone.catalogue import ORACLE, QUERIES

assert catalogue_records.query  # its queries are among the others


def test_every_initial(spark, tmp_path):
    c = duckdb.connect()
    # U+0000 and surrogates aside, every code point begins a name; each also ends one, and some names are long, blank or null
    c.execute("create table documents as select i as doc_id, chr(i::int) || 'b' as text from range(1, 1114112) t(i) where i < 55296 or i > 57343")
    c.execute("insert into documents select -i, 'x' || chr(i::int) || chr(10) || 'more' from range(1, 12288) t(i)")
    c.execute("insert into documents select 2000000 + i, repeat('ß', i::int) from range(0, 64) t(i)")
    c.execute("insert into documents values (3000000, null), (3000001, ''), (3000002, ' \t '), (3000003, chr(10) || 'ß'), (3000004, ' ßx '), (3000005, 'e' || chr(769) || 'x'), (3000006, chr(769))")
    c.execute(f"copy documents to '{tmp_path}/documents.parquet'")
    c.register("got", QUERIES["workspace_file_paths"](spark, str(tmp_path)).toArrow())
    c.execute(f"create table want as {ORACLE['workspace_file_paths']}")
    assert c.sql("select count(*) from want").fetchall() == c.sql("select count(*) from got").fetchall()
    assert c.sql("select * from want except all select * from got").fetchall()[:20] == []
