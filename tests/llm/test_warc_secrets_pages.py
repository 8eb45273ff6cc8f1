import hashlib
import re
import zlib
from collections import defaultdict

from logweave.llm import html_extraction as hx
from logweave.llm import licenses, secrets, warc

SF = "/root/testdata/sf0.001"
PAGES = [
    (1, "http://a.example/1", "<p>x</p>"), (2, "http://a.example/2", "<p>x</p>"), (2, "http://a.example/2", "<p>x</p>"), (3, None, None), (4, "http://b.example/\r\n4", ""),
    (None, "http://a.example/5", "<p>x</p>"), (6, "bad url", "a\r\n\r\nb \U0001f600"), (7, "http://[", "<div>" * 3_000 + "deep")]
SCHEMA = "page_id long, url string, html string, kept long"


def pages_of(spark, tmp_path, rows):
    path = str(tmp_path / "pages")
    spark.createDataFrame([(*r, 1) for r in rows], SCHEMA).write.parquet(path)
    return spark.read.schema(SCHEMA).parquet(path)


def test_warc_round_trip(spark, tmp_path):
    for n, df in enumerate((spark.read.parquet(f"{SF}/pages.parquet"), pages_of(spark, tmp_path, PAGES))):
        rows = df.collect()
        index = warc.write_archives(df, f"file://{tmp_path}/archives{n}")
        got = warc.read_records(index).collect()
        assert len(got) == len(rows)
        first = {}
        for r in rows:
            key = (r.html or "").encode()
            first[key] = min(first.get(key, (True, 0)), (r.page_id is None, r.page_id or 0))
        assert sorted((r.page_id is None, r.page_id or 0, len((r.html or "").encode())) for r in rows) == sorted((g.page_id is None, g.page_id or 0, g.payload_bytes) for g in got)
        assert sum(g.record_type == "response" for g in got) == len(first)
        for g in got:
            if g.record_type == "response":
                assert g.payload_digest == warc.sha1_base32(bytes(g.payload)) and first[bytes(g.payload)] == (g.page_id is None, g.page_id or 0) and g.refers_to is None
        some = warc.read_records(index.where("page_id % 2 = 0")).count()
        assert some == sum(r.page_id is not None and r.page_id % 2 == 0 for r in rows)
        place = index.where("record_type = 'response'").first()
        data = open(place.path.removeprefix("file://"), "rb").read()[place.offset : place.offset + place.length]
        assert zlib.decompress(data, 31).startswith(b"WARC/1.1\r\n")


def test_warc_ranges():
    assert warc.ranges([(0, 10), (10, 5), (100, 5), (900, 5)], gap=90, most=1_000) == [(0, 105, 0, 3), (900, 5, 3, 4)]
    assert warc.ranges([(0, 10), (10, 95)], gap=0, most=100) == [(0, 10, 0, 1), (10, 95, 1, 2)]


def test_warc_empty(spark, tmp_path):
    assert warc.read_records(warc.write_archives(pages_of(spark, tmp_path, []), f"file://{tmp_path}/none")).count() == 0


def brute_base(text):
    """Base spans by Python's engine."""
    out, text = [], text or ""
    assign = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    for place, (kind, rx) in enumerate((("assign", assign), ("access", r"AKIA[A-Z0-9]+"), ("hex", r"[0-9a-f]+"))):
        for m in re.finditer(rx, text, re.A):
            size = len(m[2]) if kind == "assign" else len(m[0])
            if size >= {"assign": 6, "access": 20, "hex": 24}[kind]:
                out.append((m.start(), place, kind, m.end()))
    return out


def test_secrets_are_brute_force(spark, docs, edge, empty, tmp_path):
    hard = ["token=token:abcdefgh password = 'x' secret:\"AKIA" + "B" * 20 + "\"", "\U0001f600 API_KEY=0123456789abcdef0123456789abcdef hex", "AKIAAKIA" + "Z9" * 10, "0" * 23 + "g" + "f" * 24, "PassWord=abc def=1"]
    live = "ghp_" + "aB3" * 13
    rows = [(i, t, "o1") for i, t in enumerate(hard)] + [(100 + i, f"k {live[:-1]}{i % 2} z eyJhbGciOiJ9.eyJzdWIiOjF9.abcdefghij", f"o{i % 2 and i}") for i in range(8)]
    path = str(tmp_path / "hard")
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(path)
    for df in (docs, edge, spark.read.parquet(path)):
        want = defaultdict(list)
        for r in df.collect():
            spans = sorted(brute_base(r.text))
            joined = ",".join(f"{k}:{a}:{b}" for a, _, k, b in spans)
            want[r.doc_id].append((hashlib.sha256(joined.encode()).hexdigest(), joined))
        got = secrets.scan(df).collect()
        assert len(got) == df.count()
        for r in got:
            match = [j for h, j in want[r.doc_id] if h == r.base_sha256]
            assert match and set(filter(None, match[0].split(","))) <= set(r.spans.split(","))
            assert (r.n_assign, r.n_access, r.n_hex) == tuple(match[0].count(f"{k}:") for k in ("assign", "access", "hex"))
    spans = {r.doc_id: r.spans for r in secrets.scan(spark.read.parquet(path)).collect()}
    assert "vendor" in spans[100] and "vendor" not in spans[101]  # one owner against four
    assert all("jwt" not in s for s in spans.values())  # five owners
    assert secrets.scan(empty).count() == 0


def test_html_main_text(spark, tmp_path):
    page = lambda i: f"""<html><head><title>t{i}</title></head><body><div class="menu"><a href="/">Home</a></div><div id="content"><h2>Head {i}</h2><p>One &amp; {i}
      two<br>three</p><form>Search</form><ul><li>a{i}<li>b</ul><div class="comments"><p>Reader {i}</p></div></div><div class="footer">Foot</div></body></html>"""  # noqa: E731
    rows = [(i, f"http://h.example/{i}", page(i)) for i in range(8)] + [
        (100, "http://x.example/", "<nav>n</nav><article><h1>T</h1><p><b>A.<br><p>B <script>x</script>c</p><aside>s</aside></article><footer>f</footer>"), *PAGES[3:6], PAGES[7]]
    got = {(r.page_id, r.url): r for r in hx.extract_pages(pages_of(spark, tmp_path, rows)).collect()}
    assert len(got) == len(rows)
    assert got[3, "http://h.example/3"].text == "Head 3\n\nOne & 3 two three\n\na3\n\nb"
    assert got[100, "http://x.example/"].text == "T\n\nA.\n\nB c"
    assert got[3, None].text == "" and got[3, None].n_chars == 0


def test_html_wrapper_groups():
    parts = [hx.template(hx.parse(f"<div><h1>{t}</h1>{'<p>x</p>' * n}{'<b>o</b>' if n > 2 else ''}<i>same</i></div>")) for t, n in (("a", 1), ("b", 3))]
    node = hx._align(*parts).kids[0]
    kinds = {x.key: (x.many, x.maybe) for x in node.kids}
    assert kinds == {"h1": (False, False), "p": (True, False), "b": (False, True), "i": (False, False)}
    assert node.kids[0].kids[0].text is None and node.kids[-1].kids[0].text == "same"


def test_licenses(spark, docs, edge, empty, tmp_path):
    cases = {
        "Intro.\nLicensed under CC BY-NC 4.0.\nMore.": "CC-BY-NC", "This work is licensed under the GNU General Public License, version 3.": "GPL", "Released under the MIT License.": "MIT",
        "x\n// SPDX-License-Identifier: Apache-2.0": "Apache-2.0", "Der Zug fährt mit der Bahn und mit dem Bus.": None, "A fishing license costs ten dollars.": None, "The general public came to the library.": None}
    path = str(tmp_path / "licenses")
    spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string").write.parquet(path)
    got = {r.doc_id: r.family for r in licenses.scan_licenses(spark.read.parquet(path)).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())
    lines = re.compile(r"licen[cs]ed? under|under the MIT License|All rights reserved", re.I)
    for r in licenses.scan_licenses(docs).join(docs.select("doc_id", "text"), "doc_id").collect():
        assert (r.family is not None) == bool(lines.search(r.text))
    assert licenses.scan_licenses(edge).count() == edge.count() and licenses.scan_licenses(empty).count() == 0
