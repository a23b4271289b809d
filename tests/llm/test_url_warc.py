import random

import compare
import pytest

from pairloom.llm import url_filter, warc
from pairloom.llm.queries import QUERIES, RULES, SQL

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_queries_against_sql(spark, name):
    assert compare.difference(QUERIES[name](spark, FOLDER), compare.connect(FOLDER), SQL[name]) is None


def judged(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fit = [r for r in rules if host and (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fit, key=lambda r: (len(r[0] + r[1]), len(r[0]), r[2] == "block"), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else "allow"


def test_rules_against_every_rule(spark):
    rng = random.Random(5)
    hosts = ["org", "example.org", "a.example.org", "xexample.org", "com", "B.com", "org.com", "", "b..org", "é.org"]
    paths = ["", "/", "/es/", "/es/x", "/en/1", "/en/12", "/fr/", "/a:b", "?q=/es/", "#x"]
    urls = [f"http{rng.choice(['s', ''])}://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(400)]
    urls += [None, "", "no scheme", "a://b://example.org/es/", "http://EXAMPLE.org/es/1"] + ["http://example.org/es/"] * 50
    rules = [*RULES, ("example.org", "/", "allow"), ("org", "/en/", "block"), ("com", "/fr/", "block"), ("", "/x", "block"), (None, "/y", "block"), ("net", None, "block")]
    pages = spark.createDataFrame([(i, u, "z") for i, u in enumerate(urls)], "page_id long, url string, host string").repartition(5)
    got = url_filter.judge_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    known = [(h, p or "", v) for h, p, v in rules if h]
    assert sorted(tuple(r) for r in got) == sorted((i, *judged(u, known)) for i, u in enumerate(urls))


def test_no_rules_and_no_urls(spark):
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")
    assert [tuple(r) for r in url_filter.judge_urls(pages, rules).collect()] == [(1, "a.b", "/c", None, "allow")]
    assert url_filter.judge_urls(pages.where("false"), rules).count() == 0


def archive(spark, tmp_path, rows, least=0, roll=None):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, sha string, payload int")
    written = warc.write_archives(pages, str(tmp_path), least=least).collect()
    names = spark.createDataFrame([tuple(r) for r in written] or [("", 0)], "archive string, n_records long").where("archive <> ''")
    return written, warc.read_archives(names, str(tmp_path))


def test_archives_keep_every_payload(spark, tmp_path):
    texts = ["<p>é\r\n\r\n</p>", None, "", "x" * 3_000_000, "dup", "dup", "\r\n\r\nWARC/1.1\r\n"]
    rows = [(i, f"http://a/{i} ü\n", t, "x", 1) for i, t in enumerate(texts)] + [(9, None, "dup", "x", 1), (None, None, "dup", "x", 1), (9, None, "dup", "x", 1)]
    written, back = archive(spark, tmp_path, rows)
    assert sum(r.n_records for r in written) == len(rows)
    found = back.collect()
    assert len(found) == len(rows)
    for r in found:
        text = dict((x[0], x[2]) for x in rows)[r.page_id] or ""
        assert r.payload_bytes == len(text.encode())
        assert bytes(r.payload) == (text.encode() if r.record_type == "response" else b"")
    kinds = sorted((r.page_id is None, r.page_id or 0, r.record_type, r.refers_to) for r in found)
    assert kinds == [
        (False, 0, "response", None), (False, 1, "response", None), (False, 2, "revisit", 1), (False, 3, "response", None), (False, 4, "response", None),
        (False, 5, "revisit", 4), (False, 6, "response", None), (False, 9, "revisit", 4), (False, 9, "revisit", 4), (True, 0, "revisit", 4),
    ]


def test_small_payloads_are_all_responses(spark, tmp_path):
    _, back = archive(spark, tmp_path, [(i, None, "same", "x", 1) for i in range(3)], least=5)
    assert {r.record_type for r in back.collect()} == {"response"}


def test_empty_table_and_damage(spark, tmp_path):
    written, back = archive(spark, tmp_path, [])
    assert written == [] and back.count() == 0
    written, back = archive(spark, tmp_path, [(1, None, "some text", "x", 1)])
    place = tmp_path / written[0].archive
    data = bytearray(place.read_bytes())
    place.write_bytes(data[:-3])
    with pytest.raises(Exception, match="ends within a member"):
        back.collect()
    block = warc.record("response", b"HTTP/1.1 200 OK\r\n\r\nabc", Content_Type="application/http", WARC_Payload_Digest="sha1:AAAA")
    with pytest.raises(ValueError, match="payload digest"):
        import io

        for pieces in warc.members(io.BytesIO(block)):
            warc.read_record(pieces)


def test_a_rule_without_path_holds_for_all_ids(spark):
    urls = spark.createDataFrame([(-i, "http://a.b") for i in range(1, 1001)] + [(5, "http://x.a.b?q"), (6, "http://b")], "page_id long, url string")
    rules = spark.createDataFrame([("a.b", "", "block")], "host string, path string, verdict string")
    got = {r.page_id: r.verdict for r in url_filter.judge_urls(urls, rules).collect()}
    assert {k for k, v in got.items() if v != "block"} == {6} and len(got) == 1002
