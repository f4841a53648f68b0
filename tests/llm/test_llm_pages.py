import io

import pytest
from helpers_llm import SF, rows_of
from pyspark.sql import functions as F
from test_llm_texts import twin

from readmend.llm import url_alias, warc
from readmend.llm.common import table

URL_COLUMNS = ("page_id", "host", "path", "rule", "verdict", "alias_verdict")


def link(u):
    return f'<html><head><link rel="canonical" href="{u}"></head>'


def refresh(u):
    return f"<META HTTP-EQUIV='Refresh' content='0; URL={u}'>"


PAGES = [
    (1, "http://a.org/x", link("https://b.example.com/en/1")), (2, "HTTP://c.org/y?z=1#f", refresh("http://a.org/x#q")),
    (3, "http://d.org/p/q", link("r")), (4, "http://d.org/p/r", refresh("//WWW.Example.com/en/k")),
    (5, "http://d.org/p/q?s=1&t=2", link("?s=1&amp;t=3")), (6, None, link("http://a.org/x")), (7, "nope", None),
    (8, "http://e.net/es/", None), (9, "http://f.info/", refresh("http://e.net/es/")),
    (10, "http://g.info", "<!--" + link("http://e.net/es/") + "-->"), (11, "http://h.info/", link("mailto:x")),
    (12, "http://i.info/a b", link("#top")), (1, "http://a.org/x", None),
    (None, "http://j.info/", "<link href=http://f.info/ rel='alternate Canonical'>"),
    (13, "http://xexample.com/en/", ""), (14, "http://net/es/x", ""), (15, "a://b://c.com/d?e/f", ""),
    (16, "http://k.net/fr", ""), (17, "http://k.com", ""), (18, "http://m.info/", refresh("/self")),
]
VERDICTS = {1: "block", 2: "block", 3: "allow", 4: "allow", 6: "allow", 8: "block", 9: "block", None: "block",
            10: "allow", 13: "allow", 14: "block", 16: "allow", 18: "allow"}


def pages(spark, rows=PAGES):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns(
        {c: F.lit("x") for c in ("host", "path", "digest", "own", "key", "refers_to")})


def test_aliases_equal_the_sql_twin(spark):
    for df in (pages(spark), pages(spark).limit(0), table(spark, SF, "pages")):
        own = df.select(F.col("page_id"), "url", "html")
        got = rows_of(url_alias.filter_pages(df), *URL_COLUMNS)
        names, rows = twin(own, url_alias.oracle(), "pages")
        assert names == list(URL_COLUMNS)
        assert got == rows


def test_aliases_follow_blocks_and_allow_goes_first(spark):
    got = {r.page_id: r.verdict for r in url_alias.filter_pages(pages(spark)).collect()}
    assert {k: got[k] for k in VERDICTS} == VERDICTS
    log = spark.createDataFrame([("http://k.net/fr", "http://e.net/fr/1"), ("http://m.info/", "http://k.net/fr"),
                                 ("http://i.info/a b", "http://k.com/"), ("http://k.com/", "http://e.net/fr/2")],
                                "url string, target string")
    got = {r.page_id: r.verdict for r in url_alias.filter_pages(pages(spark), log).collect()}
    assert got[16] == got[18] == "block" and got[12] == "allow"


def test_rules_are_checked():
    with pytest.raises(ValueError):
        url_alias.judged(None, [("block", "a.b", "/")] * 2000)


# --- archives

WARC_ROWS = [(1, "u", None), (2, "u\r\nX: y", ""), (3, None, "é" * 100), (4, "http://é x", "é" * 100),
             (None, "z", "é" * 100), (None, "z", "only"), (4, "w", "é" * 100), (3, "w", "é" * 100), (-9, "q", "x" * 300000)]
WARC_COLUMNS = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@pytest.mark.parametrize("range_bytes", [50, 1000, 4 << 20])
def test_archives_equal_the_sql_twin(spark, range_bytes):
    df = pages(spark, WARC_ROWS).unionByName(pages(spark))
    files = warc.write_warc(df)
    got = warc.read_warc(files, range_bytes)
    names, rows = twin(df.select("page_id", "url", "html"), warc.oracle(), "pages")
    assert rows_of(got, *names) == rows
    full = {r.page_id: bytes(r.payload) for r in got.collect() if r.page_id == -9}
    assert full == {-9: b"x" * 300000}


def test_whole_table_and_empty_table(spark):
    df = table(spark, SF, "pages")
    names, rows = twin(df, warc.oracle(), "pages")
    assert rows_of(warc.archived_pages(df), *names) == rows
    assert warc.archived_pages(df.limit(0)).count() == 0


def test_short_payloads_can_be_left_alone(spark):
    df = pages(spark, [(1, "a", "xy"), (2, "b", "xy"), (3, "c", "xyz"), (4, "d", "xyz")])
    got = {r.page_id: r.record_type for r in warc.read_warc(warc.write_warc(df, revisit_bytes=3)).collect()}
    assert got == {1: "response", 2: "response", 3: "response", 4: "revisit"}


class Bytes(io.BytesIO):
    def size(self):
        return len(self.getvalue())


def test_ranges_own_each_record_once():
    records = [warc.record(i, f"http://x/{i}", bytes(range(256)) * i + warc.MAGIC * 5) for i in range(12)]
    data = b"".join(records)
    whole = list(warc.records_in_range(Bytes(data), 0, len(data)))
    assert [warc.parse(c)[0] for c in whole] == list(range(12))
    for step in (1, 7, 100, 333, 5000):
        found = [c for a in range(0, len(data), step) for c in warc.records_in_range(Bytes(data), a, a + step)]
        assert found == whole


def test_damage_is_reported():
    records = [warc.record(i, "u", b"some payload") for i in range(3)]
    cut = b"".join(records)[:-9]
    with pytest.raises(warc.DamagedArchive):
        list(warc.records_in_range(Bytes(cut), 0, len(cut)))
    with pytest.raises(warc.DamagedArchive):
        list(warc.records_in_range(Bytes(records[0] + b"junk" + records[1]), 0, 10 ** 6))


@pytest.mark.parametrize("step", [1, 60, 333, 5000, 1 << 20])
def test_no_damaged_record_is_passed_over(step):
    records = [warc.record(i, f"http://x/{i}", bytes(range(256)) * (1 + i % 3) + warc.MAGIC) for i in range(6)]
    data, begin = b"".join(records), 0
    for r in records:
        for at in (0, 1, 11, len(r) // 2, len(r) - 8, len(r) - 1):
            bad = bytearray(data)
            bad[begin + at] ^= 0x40
            with pytest.raises(warc.DamagedArchive):
                for a in range(0, len(bad), step):
                    list(warc.records_in_range(Bytes(bytes(bad)), a, a + step))
        begin += len(r)


def test_a_file_of_another_length_is_reported(spark):
    files = warc.write_warc(pages(spark, WARC_ROWS))
    with pytest.raises(Exception, match="bytes of"):
        warc.read_warc(files.selectExpr("path", "bytes + 1 bytes", "records")).collect()
