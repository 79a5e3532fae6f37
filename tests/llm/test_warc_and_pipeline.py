import gzip
import hashlib
import random

import pytest

import corpus_pipeline
from phylospan.llm import warc
from phylospan.llm.queries import ORACLE_SQL, QUERIES

URLS = {
    "http://a.b.com/x?q": "com,b,a)/x?q",
    "https://u:p@Www.Ex.com:8080/é#f": "com,ex,www:8080)/é",
    "https://ex.com:443": "com,ex)/",
    "http://1.2.3.4/": "1.2.3.4)/",
    "no url": "-)no%20url",
    "http://[bad": "-)http://[bad",
    None: "-)",
}


@pytest.mark.parametrize("url", URLS)
def test_url_keys(url):
    assert warc.url_key(url) == URLS[url]


def pages():
    rng = random.Random(1)
    body = lambda n: "".join(rng.choices("abcdefgh <>\n", k=n))
    rows = [(k, f"http://h{k % 7}.example.com/p/{k}", body(rng.randint(10, 3000))) for k in range(300)]
    same, small = body(1500), body(900)
    rows += [(1000 + k, f"http://h.example.com/{k % 3}", same) for k in range(60)]
    rows += [(2000 + k, "http://h.example.com/small", small) for k in range(5)]
    return rows + [(3000, None, None), (3001, "x y", ""), (3001, "x y", same), (None, "http://e.com/", same), (1059, "http://again.com/", same), (4000, "http://long.com/", "é" * 400_000)]


def expected(rows):
    best = {}
    for i, _, h in rows:
        p = (h or "").encode()
        if len(p) >= 1000:
            best[p] = max(best.get(p, -1), -1 if i is None else i)
    out, used = [], set()
    for i, _, h in rows:
        p = (h or "").encode()
        first = p not in best or ((best[p] == i or (i is None and best[p] == -1)) and p not in used)
        if p in best and first:
            used.add(p)
        out.append((i, len(p), hashlib.sha1(p).hexdigest(), "response" if first else "revisit", None if first else best[p]))
    return sorted(map(str, out))


def test_pages_come_back(spark):
    rows = pages()
    df = spark.createDataFrame([(i, u, h, 1, 2) for i, u, h in rows], "page_id long, url string, html string, cid int, archive int")
    assert sorted(str(tuple(r)) for r in warc.archive_pages(df).collect()) == expected(rows)
    assert warc.archive_pages(df.limit(0)).count() == 0


def test_pages_of_any_plan_are_numbered_once(spark, tmp_path):
    rows = pages()
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    df.write.parquet(str(tmp_path / "pages"))
    plain = spark.read.parquet(str(tmp_path / "pages"))
    assert warc._scan_only(plain) and warc._scan_only(plain.where("page_id > 3").select("page_id", "url", "html"))
    shuffled = plain.repartition(7)
    assert not warc._scan_only(shuffled) and not warc._scan_only(df) and not warc._scan_only(plain.orderBy("html"))
    assert sorted(str(tuple(r)) for r in warc.archive_pages(shuffled).collect()) == expected(rows)
    long_page = spark.createDataFrame([(1, "http://a.com/", "<p>" * 1_000_000), (2, "http://a.com/2", "<p>" * 1_000_000)], "page_id long, url string, html string")
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.archive_pages(long_page).collect()}
    assert got == {1: (3_000_000, "revisit", 2), 2: (3_000_000, "response", None)}


def test_index_finds_what_a_scan_finds(spark, tmp_path):
    rows = pages()
    numbered = warc.number_pages(spark.createDataFrame(rows, "page_id long, url string, html string"))
    slim = numbered.selectExpr("cid", "page_id", "url", "cast(octet_length(html) as long) n", "sha1(cast(html as binary)) sha1")
    captures = warc.write_captures(numbered, slim, archive_bytes=20_000, block_lines=16, part_lines=60)
    assert len(captures.parts) > 2 and captures.blocks.count() > 10
    for url in ("http://h.example.com/small", "http://h.example.com/1", "http://h3.example.com/p/3", "http://none.com/"):
        wanted = spark.createDataFrame([(warc.url_key(url), None)], "urlkey string, cid long")
        got = sorted(r.page_id for r in warc.read_captures(captures, warc.find_captures(captures, wanted)).collect())
        assert got == sorted(i for i, u, _ in rows if u == url)
    warc.export_archives(captures, str(tmp_path / "out"))
    files = sorted((tmp_path / "out").glob("*.warc.gz"))
    assert len(files) == captures.archives.count()
    data = gzip.decompress(files[0].read_bytes())  # many members, one stream of records
    assert data.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") and data.count(b"WARC-Record-ID") > 2


def test_records():
    fields, block = warc.parse_record(warc.response_record(5, None, "http://a/ b", b"x\r\n\r\ny"))
    assert fields["WARC-Type"] == "response" and block.endswith(b"x\r\n\r\ny") and "X-Page-Id" not in fields
    member = bytearray(warc.gzip_member(warc.response_record(5, 1, "u", b"payload").replace(b"payload", b"pay1oad")))
    with pytest.raises(ValueError):
        warc.read_capture(bytes(member))


def test_pipeline(spark, tmp_path):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("an th er on in re nd ou".split(), k=rng.randint(1, 4)))
    docs, labels = [], []
    for k in range(240):
        words = [word() for _ in range(60)]
        bad, toxic = k % 5 == 0, k % 7 == 0
        if bad:
            words = [w + "***" for w in words]
        if toxic:
            for _ in range(5):
                words.insert(rng.randrange(60), rng.choice(["idiot", "loser", "scum"]))
        text = " ".join(words)
        docs.append((k, text, "en", "s", len(text)))
        labels.append((k, int(not bad), int(toxic)))
    docs += [(500 + k, docs[1][1], "en", "s", 1) for k in range(20)] + [(600, docs[2][1] + " mail a@b.org", "en", "s", 1), (700, None, "en", "s", 0), (None, docs[3][1], "en", "s", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = frame.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = spark.createDataFrame(stage(spark, frame, str(tmp_path)).collect(), frame.schema)
        assert frame.columns == columns, name
    ids = {r.doc_id for r in frame.collect()}
    clean = {k for k in range(240) if k % 5 and k % 7}
    assert len(clean - ids) <= 8 and not any(500 <= (i or 0) < 520 for i in ids)
    assert len({k for k in ids if k is not None and k < 240 and (k % 5 == 0 or k % 7 == 0)}) <= 4
    assert not any("@" in (r.text or "") for r in frame.collect())
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in packed.collect()} == ids


def test_registered_queries():
    numbers = {name.split("_")[0] for name in QUERIES}
    assert {f"op{n}" for n in range(1, 11)} | {"pipeline"} == numbers
    assert set(ORACLE_SQL) <= set(QUERIES) and corpus_pipeline.ORACLE_SQL is None


def test_sql_twins(spark, tmp_path):
    """The SQL of the operators that have one, on small tables with ties, copies and odd values."""
    import duckdb

    rng = random.Random(3)
    spark.createDataFrame([(k, u, h) for k, u, h in pages()[:370] if k is not None], "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    base = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(20)]
    near = [[x + rng.gauss(0, 0.1) for x in base[k % 5]] for k in range(40)]
    vectors = base + near + [base[0], None, [0.0] * 8, [float("nan")] * 8, [1.0]]
    spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    for name, sql in ORACLE_SQL.items():
        table = "pages" if name == "op6_warc" else "embeddings"
        con.sql(f"CREATE OR REPLACE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
        got, want = QUERIES[name](spark, str(tmp_path)), con.sql(sql)
        order = sorted(got.columns)
        assert order == sorted(want.columns)
        at = [want.columns.index(c) for c in order]
        assert sorted(str(tuple(r[c] for c in order)) for r in got.collect()) == sorted(str(tuple(r[k] for k in at)) for r in want.fetchall()), name
