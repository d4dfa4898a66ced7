"""Main text extraction and WARC archives."""

from __future__ import annotations

import base64
import gzip
import hashlib
import os
import re
import time
from html import unescape
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quittance.llm import html_blocks as h
from quittance.llm import warc as w
from quittance.llm.queries import ORACLES, QUERIES, table

SF_DIR = "/root/testdata/sf0.001"


def test_the_tree_fits_its_table_and_holds_out():
    rows, labels = h.labelled_rows()
    assert (h.trained_tree().main(rows) == labels).mean() > 0.99
    right = 0
    for fold in range(5):
        out = [k for k in range(len(labels)) if k % 5 == fold]
        rest = [k for k in range(len(labels)) if k % 5 != fold]
        right += (h.DecisionTree(rows[rest], labels[rest]).main(rows[out]) == labels[out]).sum()
    assert right / len(labels) > 0.9


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<html><body></body></html>", ""),
        ("just words", "just words"),
        ("<article><p>Be.</p><p> two\n\twords&nbsp;&amp; more </p></article>", "Be.\ntwo words & more"),
        ("<article><h1>T</h1><p>a<br>b</p><p>c<b>d</b>e", "T\na b\ncde"),
        ("<article><p>x<script>if (a<b) { '</p>' }</script>y</p></article>", "xy"),
        ("<article><p>a < b & c > d &lt;p&gt; &#233;</p></article>", "a < b & c > d <p> é"),
        ("<article><p title='a > b'>x</p><!-- <p>no</p> --></article>", "x"),
        ("<article><p>text</p><div class='ad'>buy</div><p>more</p></article>", "text\nmore"),
        ("<article><p>text</p><section id=comments><p>a reader's words</p></section></article>", "text"),
        ("<nav><a href=x>Home</a></nav><article><p>text</p></article><footer>c</footer>", "text"),
        ("<header><h1>Site</h1></header><main><p>one</p><aside>no</aside><form>no</form></main>", "one"),
        ("<div class=cookie-notice>We use cookies and more words</div><article>yes</article>", "yes"),
        ("<div role=navigation>menu</div><article><ul><li>a<li>b</ul></article>", "a\nb"),
        ("<article><table><tr><td>1<td>2<tr><td>3</table></article><div hidden>x</div>", "1\n2\n3"),
        ("<article><p>one</article><p class='x", "one"),
        ("<head><title>t</title><body><article><p>one</article>", "one"),
        ("<article><p>one<ol class=commentlist><li>no</ol><div id=pageFooter>no</div></article>", "one"),
        ("<article><p>" + "long " * 50_000 + "</p></article>", ("long " * 50_000).strip()),
    ],
)
def test_pages(page, text):
    assert h.main_texts([page], h.trained_tree()) == [text]


def test_a_page_without_an_article_is_judged_by_its_blocks():
    page = (
        "<div class=top><a href=1>Home</a> <a href=2>News</a></div><h1>A headline of some words</h1>"
        + "<p>A paragraph with a good number of words, as they are in running text.</p>" * 3
        + "<ul><li><a href=3>Another story</a></li><li><a href=4>And one more</a></li></ul>"
        + "<div id=sidebar><p>Words in the sidebar that nobody wants to read.</p></div>"
    )
    lines = h.main_texts([page], h.trained_tree())[0].split("\n")
    assert len(lines) == 4 and lines[0].startswith("A headline")


PAGES = [
    (1, "http://a", "<p>é</p>"),
    (2, "http://b", "<p>é</p>"),
    (2, "http://b", "<p>é</p>"),
    (3, None, None),
    (4, "http://c\r\nInjected: yes", ""),
    (None, "http://d", "<p>é</p>"),
    (None, None, "<p>alone</p>"),
    (0, "http://e", "x" * 300_000),
    (-5, "http://f", "x" * 300_000),
    (9, "http://g", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"),
]


def pages(spark, rows=PAGES):
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    names = "id digest first payload refers_to member text n_chars content path".split()
    return df.select("*", *[F.lit("own").alias(c) for c in names])


def test_odd_pages(spark):
    rows = h.main_text(pages(spark)).collect()
    assert len(rows) == len(PAGES)
    assert {r["text"] for r in rows if r["page_id"] in (3, 4)} == {""}
    assert all(r["n_chars"] == len(r["text"]) for r in rows)
    assert h.main_text(pages(spark).where("false")).count() == 0


def test_main_text_query(spark):
    for r in QUERIES["op10_main_text"](spark, SF_DIR).join(table(spark, SF_DIR, "pages"), "page_id").collect():
        article = re.search("<article>(.*?)(</article>|$)", r["html"], re.DOTALL)[1]
        parts = re.split("</?(?:p|h1)>", article.replace("<br>", " "))
        lines = [" ".join(unescape(re.sub("<[^>]*>", "", p)).split()) for p in parts]
        assert r["text"] == "\n".join(x for x in lines if x)


def digest(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def expected_records(rows, least=0):
    first = {}
    for k, _, html in rows:
        data = (html or "").encode()
        if k is not None and len(data) >= least:
            first[data] = min(first.get(data, k), k)
    out = []
    for k, _, html in rows:
        data = (html or "").encode()
        refers = first.get(data)
        refers = None if refers == k else refers
        out.append((k, len(data), digest(data), "revisit" if refers is not None else "response", refers))
    return sorted(out, key=str)


def written(spark, df, folder, **options):
    w.write_archives(df, folder, **options)
    return w.read_archives(spark, folder)


@pytest.mark.parametrize("least", [0, 100])
def test_archive_round_trip(spark, tmp_path, least):
    records, gaps = written(spark, pages(spark), str(tmp_path / "w"), least_bytes=least)
    rows = records.collect()
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted((tuple(r[c] for c in columns) for r in rows), key=str) == expected_records(PAGES, least)
    assert gaps.count() == 0
    for r in rows:
        if r["record_type"] == "response":
            assert digest(bytes(r["payload"])) == r["payload_digest"]
    assert {r["url"] for r in rows if r["page_id"] == 4} == {"http://c Injected: yes"}


def test_no_pages(spark, tmp_path):
    records, gaps = written(spark, pages(spark).where("false"), str(tmp_path / "w"))
    assert records.count() == gaps.count() == 0


def archive(n=8):
    """Members and their offsets."""
    made = [w.member(w.record([("WARC-Type", "response"), ("X-Page-ID", str(k))], os.urandom(200 + k))) for k in range(n)]
    offsets = [sum(map(len, made[:k])) for k in range(n)]
    return b"".join(made), offsets


def ids(data):
    found = list(w.read_file(bytes(data)))
    return [int(r[1]["x-page-id"]) for r in found if not isinstance(r, w.Gap)], [
        r for r in found if isinstance(r, w.Gap)
    ]


def test_every_damaged_byte_costs_at_most_its_record():
    data, offsets = archive()
    ends = [*offsets[1:], len(data)]
    for at in range(0, len(data), 7):
        bad = bytearray(data)
        bad[at] ^= 0xFF
        found, gaps = ids(bad)
        hit = next(k for k, e in enumerate(ends) if at < e)
        assert set(range(8)) - set(found) <= {hit}
        for g in gaps:
            assert offsets[hit] <= g.start < g.end <= ends[hit]


def test_cut_and_foreign_bytes():
    data, offsets = archive()
    found, gaps = ids(data[:-9])
    assert found == list(range(7)) and [(g.start, g.end) for g in gaps] == [(offsets[7], len(data) - 9)]
    mixed = data[: offsets[3]] + b"junk\x1f\x8b\x08 WARC/1. " + data[offsets[3] :]
    found, gaps = ids(mixed)
    assert found == list(range(8)) and gaps[0].start == offsets[3]
    assert max(g.end for g in gaps) == offsets[3] + len(b"junk\x1f\x8b\x08 WARC/1. ")
    assert ids(b"") == ([], [])
    assert ids(b"nothing here")[0] == []


def test_plain_records_are_salvaged_too():
    plain = [w.record([("X-Page-ID", str(k))], b"block %d" % k) for k in range(4)]
    bad = plain[1].replace(b"Content-Length: 7", b"Content-Length: 9")
    found, gaps = ids(plain[0] + bad + plain[2] + plain[3])
    assert found == [0, 2, 3]
    assert [(g.start, g.end) for g in gaps] == [(len(plain[0]), len(plain[0]) + len(bad))]


def test_a_wrong_block_digest_is_damage():
    block = b"what was meant"
    record = w.record([("X-Page-ID", "1"), ("WARC-Block-Digest", f"sha1:{digest(b'other')}")], block)
    found, gaps = ids(w.member(record))
    assert found == [] and gaps[0].reason == "block digest differs"


def test_members_end_in_a_zero_byte():
    for size in (0, 10, (1 << 24) + 5):
        made = w.member(os.urandom(size))
        assert made[-1] == 0
    record = w.record([("X-Page-ID", "1")], os.urandom(1 << 24))
    found, gaps = ids(w.member(record) + w.member(w.record([("X-Page-ID", "2")], b"")))
    assert found == [1, 2] and not gaps


def test_damaged_files_on_spark(spark, tmp_path):
    folder = tmp_path / "w"
    w.write_archives(pages(spark, [(k, "u", "page %d" % k * 50) for k in range(20)]).coalesce(1), str(folder))
    (part,) = [p for p in folder.iterdir() if p.name.startswith("part-")]
    data = bytearray(part.read_bytes())
    data[len(data) // 2] ^= 0xFF
    Path(part).write_bytes(data)
    (folder / f".{part.name}.crc").unlink()
    records, gaps = w.read_archives(spark, str(folder))
    assert records.count() == 19
    (gap,) = gaps.collect()
    assert gap["start"] < len(data) // 2 < gap["end"] and gap["reason"]


def test_warc_oracle(spark):
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF_DIR}/pages.parquet'")
        expected = sorted(con.execute(ORACLES["op7_warc"]).fetchall(), key=str)
    rows = [tuple(r) for r in table(spark, SF_DIR, "pages").select("page_id", "url", "html").collect()]
    assert expected == expected_records(rows)


def test_warc_query(spark):
    rows = [tuple(r) for r in table(spark, SF_DIR, "pages").select("page_id", "url", "html").collect()]
    got = sorted(map(tuple, QUERIES["op7_warc"](spark, SF_DIR).collect()), key=str)
    assert got == expected_records(rows)


def test_the_article_is_kept_whole_and_nothing_around_it():
    """Whatever its words and neighbours, a block's place decides where a page has an article."""
    tree, around = h.trained_tree(), [(1, 0, 0), (0, 1, 0), (1, 0, 1), (0, 1, 1), (0, 0, 1)]
    grid = [
        (w, d, wb, db, wa, da, *place, head)
        for w in (1, 2, 3, 8, 30, 100)
        for d in (0, 0.2, 0.5, 1)
        for wb, db in ((0, 0), (1, 0), (3, 1), (40, 0.1))
        for wa, da in ((0, 0), (1, 1), (3, 0), (9, 0.6), (40, 0))
        for place in around
        for head in (0, 1)
    ]
    rows = np.array(grid, float)
    assert (tree.main(rows) == ((rows[:, 6] == 1) & (rows[:, 8] == 0))).all()


def test_headers_of_any_size_are_read(spark, tmp_path):
    rows = [(1, "http://a?" + "q" * 70_000, "<p>a</p>"), (2, "data:," + "x" * 5_000_000, "<p>b</p>"), (3, "u", "")]
    records, gaps = written(spark, pages(spark, rows), str(tmp_path / "w"))
    assert {(r["page_id"], r["url"]) for r in records.collect()} == {r[:2] for r in rows}
    assert gaps.count() == 0
    assert ids(b"WARC/1.1\r\nX-Page-ID: 1\r\n")[1][0].reason == "headers do not end"


def test_gaps_fail_a_reader_that_wants_all(spark, tmp_path):
    (tmp_path / "part").write_bytes(archive(3)[0][:-9])
    records, _ = w.read_archives(spark, str(tmp_path), whole=True)
    with pytest.raises(Exception, match="bytes"):
        records.collect()


def whole_records(n=6, size=3000):
    """Plain records with digests, of blocks that do not pack well."""
    out = []
    for k in range(n):
        block = base64.b64encode(os.urandom(size))
        headers = [("X-Page-ID", str(k)), ("WARC-Block-Digest", f"sha1:{digest(block)}")]
        out.append(w.record(headers, block))
    return out


@pytest.mark.parametrize("level", [0, 6])
def test_records_of_one_member_are_salvaged(level):
    made = whole_records()
    bad = [*made[:2], made[2].replace(b"Content-Length: 4000", b"Content-Length: 4001"), *made[3:]]
    found, gaps = ids(gzip.compress(b"".join(bad), level) + w.member(whole_records(1)[0]))
    assert found == [0, 1, 3, 4, 5, 0] and len(gaps) == 1
    at = len(made[0]) + len(made[1])
    assert f"bytes {at} to {at + len(made[2])} of the content" in gaps[0].reason

    packed = gzip.compress(b"".join(made), level)
    after = w.member(w.record([("X-Page-ID", "9")], b"good"))
    for damaged, least in (
        (packed[:-8] + b"\0\0\0\0" + packed[-4:], 6),  # the checksum
        (packed[: len(packed) * 2 // 3], 3),  # the end
        (packed[: len(packed) * 2 // 3] + after, 3),
        (packed[: len(packed) * 2 // 3] + b"\xff" * 300 + packed[len(packed) * 2 // 3 + 300 :] + after, 3),
    ):
        found, gaps = ids(damaged)
        rest = [k for k in found if k != 9]
        assert len(rest) >= least and rest == sorted(set(rest)) and gaps
        assert (9 in found) == damaged.endswith(after)


def test_records_without_a_digest_before_a_cut_are_kept():
    made = [w.record([("X-Page-ID", str(k))], os.urandom(500)) for k in range(5)]
    found, gaps = ids(gzip.compress(b"".join(made))[:-400])
    assert found == [0, 1, 2, 3] and gaps[0].reason.startswith("member: cut short")


WORDS = " ".join(["A paragraph with a good number of words, as they are in running text."] * 4)


@pytest.mark.parametrize(
    "page",
    [
        "<nav><a href=1>Home</a></nav><div class='content has-sidebar'><h1>A title of words</h1>{}</div><div class=sidebar>No</div>",
        "<nav><a href=1>Home</a></nav><div id='search-results'><article><h1>A title of words</h1>{}</article></div>",
        "<main><h1>A title of words</h1><div id='search-results'>{}</div></main>",
        "<article class='post category-legal comments-open'><h1>A title of words</h1>{}</article>",
        "<body><form id=aspnetForm><div class=menu><a href=1>Home</a></div><h1>A title of words</h1>{}"
        "<div class=footer><p>No words of the text</p></div></form>",
    ],
)
def test_wrappers_with_telling_names_keep_their_article(page):
    text = h.main_texts([page.format(f"<p>{WORDS}</p>" * 3)], h.trained_tree())[0]
    assert text.split("\n") == ["A title of words", *[WORDS] * 3]


def test_hinted_parts_beside_an_article_stay_out():
    comments = f"<div class=comments>{f'<article><p>{WORDS}</p></article>' * 9}</div>"
    page = f"<article><p>{WORDS}</p></article>{comments}<form><p>{WORDS}</p></form>"
    assert h.main_texts([page], h.trained_tree()) == [WORDS]


def test_a_wrapper_of_most_words_leaves_the_choice_to_words_and_links():
    rows, labels = h.labelled_rows()
    partly = (rows[:, 8] > 0) & (rows[:, 8] < 1)
    assert {0, 1} == set(labels[partly])


@pytest.mark.parametrize(
    ("page", "text"),
    [
        *((f"<article><p>one</p><{n} id=x>not this<p>two</p></article>", "one\ntwo") for n in ("canvas", "object", "svg", "iframe", "select")),
        ("<article><p>one <svg><path d=x></p><p>two</p></article>", "one\ntwo"),
        ("<article><p>one <svg><b>no</b></svg>two</p></article>", "one two"),
        ("<article><p>one</p><script>x<p>two</p></article>", "one"),
        ("<article><p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p></article>", "so x=2 holds"),
    ],
)
def test_elements_without_their_end_tag(page, text):
    assert h.main_texts([page], h.trained_tree()) == [text]


def test_deep_and_broken_pages_cost_by_their_length():
    """Elements that never end, end tags that open nothing, thousands of hinted ones in each other."""
    pages = [
        "<div>" * 40_000 + "</ul>" * 40_000 + "words of text",
        "<div class=sidebar><p>some words here and there" * 20_000,
        "<div>" * 30_000 + "deep words" + "</div>" * 30_000,
        "<table><tr><td>" * 15_000 + "cells",
    ]
    for page in pages:
        start = time.process_time()
        texts, rows = h.page_blocks(page)
        assert len(texts) == len(rows) > 0
        assert time.process_time() - start < 15
