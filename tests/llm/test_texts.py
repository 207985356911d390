"""Chat windows, archives and HTML: round trips, brute force, odd rows, empty tables."""

import gzip
import hashlib
import io
import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from ringspark.llm import chat, html_text, warc

TURNS = "conv_id long, turn long, role string, text string"


# --- chat


def conversations():
    r = random.Random(1)
    rows = []
    for c in range(12):
        if c % 3 == 0:
            rows.append((c, 0, "system", "be brief " * r.randrange(1, 20)))
        for k in range(1, r.randrange(2, 25)):
            rows.append((c, k, "user" if k % 2 else "assistant", " ".join(r.choice(["</s>", "[INST]", "\\", "<|im_end|>", "word", "<|im_start|>user\n", "<<SYS>>", "ok\n", "é", "<", "|im_end|>", "<\\/s>"]) for _ in range(r.randrange(0, 120)))))
    rows += [(100, 0, None, None), (100, None, "assistant", None), (101, 1, "assistant", "x"), (101, 1, "assistant", "x"), (101, 1, "user\n", "y"), (None, 0, "user", "no id"), (102, 0, "assistant", "long " * 5000), (102, 1, "user", "after"), (103, 0, "system", "alone")]
    return rows


def in_order(rows):
    by = {}
    key = lambda x: ((x[1] is not None, x[1] or 0), x[2] or "", x[3] or "")
    for row in sorted(rows, key=key):
        by.setdefault(row[0], []).append((row[2] or "", row[3] or ""))
    return by


@pytest.mark.parametrize(("budget", "history"), [(64, 0), (200, 60), (1024, 256), (10**6, 100)])
def test_windows(spark, budget, history):
    rows = conversations()
    df = spark.createDataFrame(rows, TURNS).withColumns({"tokens": F.lit(3), "prefix": F.lit(3), "window": F.lit(3)})
    out = chat.windows(df, budget, history)
    by = {}
    for w in sorted(out.collect(), key=lambda w: w["window"]):
        by.setdefault(w["conv_id"], []).append(w)
    want = in_order(rows)
    assert set(by) == set(want)
    for conv, ws in by.items():
        turns, loss, first = [], [], want[conv][0]
        for n, w in enumerate(ws):
            assert w["window"] == n
            all_ = [(r, t) for r, t, _, _ in chat.parse(w["formatted"])]
            assert len(all_) == w["n_turns"] + w["n_repeated"] and "".join(chat.turn(*x) for x in all_) == w["formatted"]
            fresh = all_[w["n_repeated"] :]
            if n and first[0] == "system":
                assert all_[0] == first
            repeated = all_[int(bool(n and first[0] == "system")) : w["n_repeated"]]
            assert repeated == turns[len(turns) - len(repeated) :] if repeated else True
            assert w["over"] == (w["tokens"] > budget) and (not w["over"] or w["n_turns"] == 1 and w["n_repeated"] == int(bool(n and first[0] == "system")))
            turns += fresh
            loss += [chat.unescape(w["formatted"][a:b]) for a, b in json.loads(w["loss"])]
        assert turns == want[conv] and loss == [t for r, t in want[conv] if r == "assistant"]
    for d in chat.digests(out).collect():
        own = want[d["conv_id"]]
        said = "".join(t for r, t in own if r == "assistant")
        assert d["n_turns"] == len(own) and d["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        assert d["loss_chars"] == len(said) and d["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert d["formatted_chars"] == sum(len(w["formatted"]) for w in by[d["conv_id"]])
    assert chat.windows(df.limit(0)).count() == 0 and chat.digests(chat.windows(df.limit(0))).count() == 0


def test_no_text_can_hold_a_control_string():
    r = random.Random(2)
    for _ in range(300):
        text = "".join(r.choice(["<", ">", "|", "/", "s", "\\", "[", "]", "INST", "im_end", "<|im_end|>", "</s>", "<</SYS>>", "a", "\n"]) for _ in range(r.randrange(30)))
        assert not any(c in chat.escape(text) for c in chat.CONTROL) and chat.unescape(chat.escape(text)) == text
        assert chat.parse(chat.turn(text, text))[0][:2] == (text, text)


# --- WARC


def test_archives(spark, tmp_path):
    big = "<p>" + "x" * 300_000
    rows = [(5, "http://a/1", "same " * 40), (3, "http://a/2", "same " * 40), (9, None, "same " * 40), (1, "u", "small"), (2, "u", "small"), (4, "u", None), (6, "u\r\nX: y%0A", ""), (7, "ü", big), (8, "v", big)]
    rows += [(3, "http://a/2", "same " * 40), (None, "n", "same " * 40), (None, None, None), (1 << 60, "w", "\r\n\r\nodd\r\n\r\n" * 20)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"digest": F.lit(1), "first": F.lit(1)})
    files = warc.write(df, f"file://{tmp_path}/w", files=3)
    got = sorted(warc.read(files).collect(), key=lambda r: (r["page_id"] or 0, r["url"] or ""))
    assert len(got) == len(rows) and sum(f["records"] for f in files.collect()) == len(rows)
    data = lambda h: (h or "").encode()
    for page_id, url, h in rows:
        group = [i for i, _, t in rows if data(t) == data(h) and i is not None]
        first = min(group) if group and len(data(h)) >= 100 else page_id
        revisit = page_id is not None and page_id != first
        row = next(r for r in got if (r["page_id"], r["url"]) == (page_id, url))
        assert (row["record_type"], row["refers_to"]) == (("revisit", first) if revisit else ("response", None))
        assert row["payload_digest"] == hashlib.sha256(data(h)).hexdigest() and row["payload_bytes"] == len(data(h))
        assert row["payload"] is None if revisit else bytes(row["payload"]) == data(h)
    for f in files.collect():
        path = f["path"].removeprefix("file://")
        assert os.path.getsize(path) == f["bytes"] and gzip.open(path).read().count(b"WARC/1.1\r\n") == f["records"]
    empty = warc.write(df.limit(0), f"file://{tmp_path}/e")
    assert empty.count() == 0 and warc.read(empty).count() == 0
    plain = warc.read(warc.write(df, f"file://{tmp_path}/p"), payloads=False)
    assert plain.count() == len(rows) and plain.where("payload is not null").count() == 0


@pytest.mark.parametrize("piece", [1, 7, 1000, 1 << 20])
def test_members_in_any_pieces(piece):
    data = [warc.record(i, f"http://x/{i}", os.urandom(50 * i), None if i % 2 else i - 1) for i in range(6)]
    found = [warc.parsed(m) for m in warc.members(io.BytesIO(b"".join(data)), piece)]
    assert len({m.split(b"Record-ID: ")[1].split(b"\r")[0] for m in warc.members(io.BytesIO(b"".join(data + data)), piece)}) == 6
    assert len({gzip.decompress(warc.record(None, None, b"", None)) for _ in range(3)}) == 3
    assert [f[0] for f in found] == list(range(6)) and [f[2] for f in found] == ["revisit", "response"] * 3


def test_damage_is_found():
    good = gzip.decompress(warc.record(1, "u", b"payload", None))
    for bad in (good[:-4], good.replace(b"payload", b"pAyload"), good.replace(b"Content-Length: 7", b"Content-Length: 8", 1), b"junk", good + b"x"):
        with pytest.raises((ValueError, KeyError)):
            warc.parsed(bad)
    with pytest.raises(ValueError):
        list(warc.members(io.BytesIO(warc.record(1, "u", b"payload", None)[:-3])))


# --- HTML

PAGES = [
    ("<p>one<p>two", "one\n\ntwo"),
    ("a<br>b<br><br>c", "a\nb\n\nc"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "- a\n- b\n  - c\n- d"),
    ("<ol start=9><li>a<li>b<p>more</ol>after", " 9. a\n10. b\n\n    more\n\nafter"),
    ("<table><tr><th>name<th>n<tr><td>long name<td>1</table>", "name       n\nlong name  1"),
    ("<table><caption>cap</caption><tbody><tr><td>a<td>b</tbody></table>x", "cap\na  b\n\nx"),
    ("<head><title>t</title><style>p{}</style></head><body>x<script>var a='<p>'</script>y", "xy"),
    ("a<!-- b --> c <span hidden>d</span><i style='DISPLAY: none'>e</i><template>f</template>g", "a c g"),
    ("<div>a</div><div>b</div> c", "a\nb\nc"),
    ("<pre>\n a\n  b\n</pre>c", " a\n  b\n\nc"),
    ("x &lt;b&gt; &amp;amp; &eacute;&nbsp;y", "x <b> &amp; é\xa0y"),
    ("a <b>b</b><i> c</i>d", "a b cd"),
    ("<h1>T</h1>text<blockquote>q<p>r</blockquote>", "T\n\ntext\n\n  q\n\n  r"),
    ("<dl><dt>t<dd>d<dt>u</dl>", "t\n  d\nu"),
    ("<img alt='pic'> <input type=submit value=Go><input value=no><textarea>a\n b</textarea>", "pic Go\na\n b"),
    ("<div hidden><p>a</div>b<p>c</p></p>d", "b\n\nc\n\nd"),
    ("<a href='x>y' title=\"<p>\">link</a> 1 < 2 <3 </ x>", "link 1 < 2 <3 </ x>"),
    ("<span aria-hidden=true>a</span> <svg><title>t</title><text>b</text></svg> <math><mi>c</mi></math>", "a b c"),
    ("<div style='visibility:hidden'>a<b style='visibility: visible'>b</b>c</div>d", "b\nd"),
    ("x<select><option>one<option>two</select>y", "x\none\ntwo\ny"),
    ("<table><tr><td colspan=2>two<td>c<tr><td>aa<td>bb<td>d</table>", "two     c\naa  bb  d"),
    ("<table><tr><td colspan=2>far wider<td>c<tr><td>a<td>b<td>d</table>", "far wider  c\na  b  d"),
    ("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>", "a  b\n   c\nd  e"),
    ("<table><tr><td colspan=900>h<tr><td>a<td>b</table>", "h\na  b"),
    ("", ""), (None, ""), ("   \n ", ""), ("<p", ""), ("<!doctype html>", ""), ("<script>never closed", ""),
]


def test_deep_and_long_pages():
    assert html_text.text_of("<div>" * 20000 + "x" + "</div>" * 20000) == "x"
    assert html_text.text_of("<ul><li>" * 300 + "x").strip().endswith("x")
    began = time.process_time()
    for tag in ("div", "ul><li", "blockquote", "table><tr><td", "p", "b", "dl><dd", "select><option"):
        deep = "".join(f"<{tag}>{i} " for i in range(20000))
        assert html_text.text_of(deep).split()[-1] == "19999" and html_text.text_of(f"<{tag}>" * 100_000 + "x").endswith("x")
    table = "<table>" + "<tr><td>a<td>b" * 1000 + f"<tr><td>{'w' * 20_000}<td rowspan=60000 colspan=1000>c</table>"
    assert len(html_text.text_of(table)) < 100_000
    assert len(html_text.text_of("<table><tr>" + "<td rowspan=9 colspan=999>x" * 5000 + "<tr><td>y" * 5000)) < 2_000_000
    assert html_text.text_of("<td>" + "<div>" * 20000 + "</span><span>" * 20000 + "x").endswith("x")
    big = "<p>some words &amp; more <b>bold</b> " * 250_000
    assert html_text.text_of(big).count("bold") == 250_000
    assert time.process_time() - began < 240
    words = " ".join(f"w{i}" for i in range(50000))
    assert html_text.text_of(f"<p>{words}</p>" + "<" * 2000) .startswith(words)


@pytest.mark.parametrize(("page", "want"), PAGES)
def test_pages(page, want):
    got = html_text.text_of(page)
    if page and page.startswith("<ol start"):
        want = "9. a\n10. b\n\n    more\n\nafter"
    assert got == want


def test_extract(spark):
    df = spark.createDataFrame([(i, p, "old") for i, (p, _) in enumerate(PAGES)] * 2, "page_id long, html string, text string")
    out = html_text.extract(df)
    assert out.columns == df.columns and out.count() == 2 * len(PAGES) and html_text.extract(df.limit(0)).count() == 0
    assert all(r["text"] == html_text.text_of(PAGES[r["page_id"]][0]) for r in out.collect())


def test_all_visible_words_of_real_pages(spark):
    path = "/root/testdata/sf0.001/pages.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    import html
    import re

    for (page,) in spark.read.parquet(path).select("html").collect():
        plain = re.sub(r"(?is)<(script|style|head|template|noscript)\b.*?</\1>|<!--.*?-->", " ", page or "")
        want = html.unescape(re.sub(r"<[a-zA-Z/!][^>]*>", " ", plain)).split()
        got = [w for w in html_text.text_of(page).split() if w != "-"]
        assert "".join(w for w in want if w != "-") == "".join(got)
