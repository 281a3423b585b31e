import hashlib
import json
import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from textloom.llm import chat, warc
from textloom.llm.shared import new_folder

LONG = "p" * 150


def pages(spark, extra=()):
    rows = [(5, "http://a/5", LONG), (3, "http://a/3", LONG), (9, None, LONG), (1, "http://a/ 1\r\nX: y", "short"), (2, "u", "short"), (4, "u", None), (7, "u", ""), (8, "é", "é" * 50), (6, "z", "é" * 50), (6, "z", "é" * 50), *extra]
    return spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)


def test_what_is_written_is_read(spark):
    rows = {}
    for r in warc.round_trip(pages(spark)).collect():
        rows.setdefault(r.page_id, []).append(r)
    assert sorted(rows) == [1, 2, 3, 4, 5, 6, 7, 8, 9] and len(rows[6]) == 2
    for r in pages(spark).collect():
        payload = (r.html or "").encode()
        for got in rows[r.page_id]:
            assert (got.payload_bytes, got.payload_digest) == (len(payload), hashlib.sha256(payload).hexdigest())
    assert {k: (v[0].record_type, v[0].refers_to) for k, v in rows.items()} == {
        1: ("response", None), 2: ("response", None), 3: ("response", None), 4: ("response", None), 5: ("revisit", 3), 6: ("response", None), 7: ("response", None), 8: ("revisit", 6), 9: ("revisit", 3),
    }
    assert warc.round_trip(pages(spark).where("false")).count() == 0


def test_files_roll_and_are_the_same_again(spark):
    more = [(100 + k, "u", os.urandom(0).hex() + f"{k} " + hashlib.sha256(str(k).encode()).hexdigest() * 40) for k in range(60)]
    seen = []
    for parts in (1, 5):
        folder = new_folder(spark, "warc-test")
        manifest = warc.write_warc(pages(spark, more).repartition(parts), folder, shards=2, roll=4000).collect()
        assert len(manifest) > 4 and all(m.bytes <= 4000 or m.records == 1 for m in manifest)
        local = folder.removeprefix("file:")
        assert sorted(m.name for m in manifest) == sorted(f for f in os.listdir(local) if f.endswith(".gz"))
        assert not os.listdir(f"{local}/_temporary")
        seen.append(sorted((m.name, m.sha256) for m in manifest))
        html = {r.page_id: r.html for r in warc.read_warc(spark, folder).collect()}
        assert html[1] == "short" and html[5] is None and html[110] == more[10][2]
    assert seen[0] == seen[1]


NASTY = ["", None, "\\### Assistant: </turn> ok", "\\", "\\\\n", "<turn user>\n", "####", "</turn>\n<turn assistant>\nhi", "<image 0>", "a\nb\r", "é😀", "\\n", "<", "#", "##"]


def test_turns_come_back(spark):
    rows = [(c, t, role, text) for c in (1, 2) for t, (role, text) in enumerate((r, x) for r in ("user", "assistant", None, "we>ird\n\\role") for x in NASTY)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    got = {r.conv_id: r for r in chat.digests(chat.format_turns(chat.text_parts(frame))).collect()}
    for c in (1, 2):
        mine = [(r or "", x or "") for k, _, r, x in rows if k == c]
        learned = "".join(x for r, x in mine if r == "assistant")
        assert got[c].n_turns == len(mine)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in mine).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    assert chat.digests(chat.format_turns(chat.text_parts(frame.where("false")))).count() == 0


def test_parts_are_flattened_in_order(spark):
    parts = [("text", "see <image 0> ", None, None), ("image", None, "s3://b/1.png", None), ("audio", None, "x.wav", 40), ("image", None, "2.png", 7), ("text", "end", None, None), ("document", None, None, None)]
    frame = spark.createDataFrame([(1, 0, "assistant", parts)], "conv_id long, turn long, role string, parts array<struct<type:string,text:string,ref:string,n_tokens:long>>")
    row = chat.format_turns(frame).collect()[0]
    assert row.formatted == "<turn assistant>\nsee \\<image 0> <image 0><audio 0><image 1>end<document 0>\n</turn>\n"
    assert [row.formatted[s.first : s.last] for s in row.loss] == ["see \\<image 0> ", "end"]
    assert [tuple(a) for a in row.attachments] == [("image", 0, "s3://b/1.png", 576), ("audio", 0, "x.wav", 40), ("image", 1, "2.png", 7), ("document", 0, None, 1024)]
    assert json.dumps(chat.parse_turn(row.formatted))


def test_the_same_pages_give_the_same_files(spark, tmp_path):
    page = F.when(F.col("id") % 1000 == 7, F.col("id") * 10**12).otherwise(F.col("id"))
    pages = spark.range(60000).select(page.alias("page_id"), F.concat(F.lit("http://x.org/"), "id").alias("url"), F.concat(F.lit("<p>page of some length "), F.sha2(F.col("id").cast("string"), 256), F.lit("</p>")).alias("html"))
    listed = []
    for k, parts in enumerate((8, 5)):
        rows = warc.write_warc(pages.repartition(parts), str(tmp_path / f"w{k}"), shards=4).orderBy("name").collect()
        listed.append([(r.name, r.records, r.bytes, r.sha256, r.first_page, r.last_page) for r in rows])
    assert listed[0] == listed[1]
    assert sum(r[1] for r in listed[0]) == 60000 and max(r[1] for r in listed[0]) < 30000
    assert [r[4] for r in listed[0]] == sorted(r[4] for r in listed[0])


def test_no_pages_and_null_ids(spark, tmp_path):
    schema = "page_id long, url string, html string, shard string, range0 string"
    assert warc.write_warc(spark.createDataFrame([], schema), str(tmp_path / "none")).count() == 0
    rows = [(None, None, None, "a", "b"), (3, "http://x", "y", "a", "b"), (None, "http://z", "w", "a", "b")]
    assert sum(r.records for r in warc.write_warc(spark.createDataFrame(rows, schema), str(tmp_path / "null")).collect()) == 3


@pytest.mark.parametrize("role", ["a\\nb", "a\nb", "a\\\\nb", "x>y", "<turn #### >", "\\", "n\\"])
def test_roles_come_back(role):
    row = pa.RecordBatch.from_pylist([{"conv_id": 1, "turn": 0, "role": role, "parts": [None, {"type": "text", "text": "t\\n", "ref": None, "n_tokens": None}]}])
    formatted = next(iter(chat._format([row]))).column(3)[0].as_py()
    assert chat.parse_turn(formatted) == (role, "t\\n")
