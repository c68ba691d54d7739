"""The token operator reads its shards back once; the index holds what that pass found."""

import tempfile
import zlib

from deliverix.llm import token_output


def test_index_holds_each_records_place_and_checksum(spark, make_docs):
    path = tempfile.mkdtemp() + "/tokens"
    token_output.write_tokens(make_docs([(i, f"text number {i} " * (i % 5)) for i in range(40)] + [(None, None), (7, "again")]), path)
    index = spark.read.parquet(f"{path}/index")
    read = token_output.read_records(spark, path)
    assert index.exceptAll(read.select(index.columns)).isEmpty() and index.count() == read.count() == 42
    data = {f.path.rpartition("/")[2]: bytes(f.content) for f in spark.read.format("binaryFile").load(f"{path}/records").collect()}
    for r in index.collect():
        doc, ids = token_output.read_tokens(data[r.shard], r.offset, r.length)
        assert (doc, len(ids), zlib.crc32(ids.astype("<u4"))) == (r.id, r.n_tokens, r.ids_crc32)


def test_shards_are_read_once(spark, make_docs, monkeypatch):
    passes = []
    read = token_output.read_records
    monkeypatch.setattr(token_output, "read_records", lambda *a: passes.append(a) or read(*a))
    got = token_output.query(make_docs([(2, "two words"), (1, ""), (None, "x")])).orderBy("start").collect()
    assert len(passes) == 1
    assert [r.doc_id for r in got] == [None, 1, 2] and [r.start for r in got] == [0, got[0].n_tokens, got[0].n_tokens + 1]
