"""Decontamination, token counts, HTML, licenses, WARC and quality against brute force, with odd rows."""

import base64
import gzip
import hashlib
import html
import io
import random
import re

import numpy as np
import pytest

from tagspace.llm import decontaminate, html_text, license_scan, quality_gam, queries, unigram_counts, warc

SF01 = "/root/testdata/sf0.01"
LOWER = str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})


def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, key long, row string")


def pages(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, key long, path string")


# --- decontamination ---------------------------------------------------------------------

def prose(n, seed, size=900):
    r = random.Random(seed)
    return [f"{r.choice('bcdfgklmnprst')}{r.choice('aeiou')}x{r.randrange(size)}" for _ in range(n)]


def benchmark(spark, items):
    return spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id long")


def test_contaminated_exact_paraphrased_and_clean(spark):
    r = random.Random(4)
    items = [(k, " ".join(prose(24, 1000 + k)) + ". " + " ".join(prose(6, 2000 + k))) for k in range(30)]
    items += [(90, None), (91, ""), (92, "...")]
    rows, want = [], set()
    for i in range(200):
        w = prose(r.randrange(20, 200), i)
        if i % 4 == 0:
            k = i // 4 % 30
            own = items[k][1].split()
            if i % 8 == 0:  # a paraphrase: one word in eight replaced, the case changed
                own = [x if j % 8 else "other" for j, x in enumerate(own)]
                own[0] = own[0].upper()
            at = r.randrange(len(w) + 1)
            w[at:at] = own
            want.add((i, k))
        elif i % 4 == 1:  # a quarter of an item is no item
            w[3:3] = items[i % 30][1].split()[:7]
        rows.append((i, r.choice([" ", "\n"]).join(w)))
    rows += [(500, None), (501, ""), (502, " ".join(prose(20_000, 7)) + " " + items[3][1]), (None, "plain")]
    want.add((502, 3))
    got = decontaminate.contaminated(docs(spark, rows), benchmark(spark, items))
    assert {(x.doc_id, x.item_id) for x in got.collect()} == want
    blocks = decontaminate.contaminated(docs(spark, rows), benchmark(spark, items), block_items=11)
    assert {(x.doc_id, x.item_id) for x in blocks.collect()} == want
    left = decontaminate.drop_contaminated(docs(spark, rows), benchmark(spark, items))
    assert left.count() == len(rows) - len({d for d, _ in want})


def test_contaminated_without_rows(spark):
    some, none = docs(spark, [(1, "a b c")]), docs(spark, [(1, "a b c")]).limit(0)
    items = benchmark(spark, [(1, "a b c d e f g")])
    assert decontaminate.contaminated(none, items).count() == 0
    assert decontaminate.contaminated(some, items.limit(0)).count() == 0


def test_contaminated_finds_every_whole_item_on_table(spark):
    texts = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{SF01}/benchmark.parquet").collect()
    joined = [(r.item_id, f" {' '.join(decontaminate._words(r.text))} ") for r in items]
    want = {(d, i) for d, t in texts for i, b in joined if b in f" {' '.join(decontaminate._words(t))} "}
    got = {(x.doc_id, x.item_id) for x in queries.QUERIES["op1_decontaminate"](spark, SF01).collect()}
    assert want and got == want


def test_subsequence_share_against_table():
    r = random.Random(1)
    items = decontaminate.Items.of([(0, "a b c d e f g h. c a")])
    items.weigh(100, np.ones(len(items.vocabulary)))
    own = items.tokens[0].tolist()
    for _ in range(50):
        region = [r.choice(own) for _ in range(r.randrange(30))]
        t = [[0] * (len(region) + 1) for _ in range(len(own) + 1)]
        for i, x in enumerate(own):
            for j, y in enumerate(region):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert items.shares(0, region)[0] == t[-1][-1] / len(own)


# --- token counts ------------------------------------------------------------------------

def test_token_counts_equal_the_tokenizer(spark):
    tokenizers = pytest.importorskip("tokenizers")
    pieces = unigram_counts.unigram_pieces(unigram_counts.default_vocabulary())
    ref = tokenizers.Tokenizer(tokenizers.models.Unigram([*pieces, ("<unk>", 0.0)], unk_id=len(pieces), byte_fallback=False))
    ref.pre_tokenizer = tokenizers.pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    texts = [r.text for r in spark.read.parquet(f"{SF01}/documents.parquet").select("text").limit(300).collect()]
    texts += ["", " ", "  a  b", "☃☃ x☃", "日本語 é", "▁▁ k", "\n\n a", "a" * 3000, None, "tab\tand nul\x00"]
    got = {r.doc_id: (r.n_chars, r.n_tokens) for r in
           unigram_counts.token_counts(docs(spark, list(enumerate(texts)))).collect()}
    want = {i: (len(t or ""), len(ref.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(texts)}
    assert got == want
    assert unigram_counts.token_counts(docs(spark, [(1, "a")]).limit(0)).count() == 0


def test_viterbi_ties_and_unknowns():
    c = unigram_counts.Counter([("▁", -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁a", -2.0)])
    assert c.viterbi("▁ab") == 2       # equal scores: the longer last piece stays
    assert c.viterbi("▁☃☃a") == 3      # a run of unknown characters is one token
    assert c.count("") == 0


# --- html --------------------------------------------------------------------------------

def test_main_text_zones_entities_and_white_space():
    page = ("<html><head><title>No</title><style>p{}</style></head><body><header><h1>Site</h1></header>"
            "<nav><ul><li>Menu</li></ul></nav><div class='cookie-notice'>Cookies</div>"
            "<article><header><h2>Head &amp; line</h2><span>by X</span></header><p>One&nbsp;  two<br>three <b>fo</b>ur</p>"
            "<aside>Aside</aside><form><p>Form</p></form><script>var t='</p>';</script><p>Five &lt;6&gt; &#233;"
            "<div class=\"ad\">Buy</div><ul><li>A</li><li>B</li></ul><!-- no --></article>"
            "<section id=comments><article class=comment><p>Reader</p></article></section><footer>Foot</footer>")
    got = "\n".join(t for z, t in html_text.page_blocks(page) if z == "article")
    assert got == "Head & line\nOne two three four\nFive <6> é\nA\nB"


def test_main_text_of_plain_elements():
    page = ("<body><div id='top'>Site</div><div class='menu'>Menu</div><div class='wrap'><div class='post-content big'>"
            "<div class='entry-header'><h1>Title</h1>by</div><div><p>A</p></div><div>B</div></div><div>other</div></div>")
    assert [t for z, t in html_text.page_blocks(page) if z == "main"] == ["Title", "A", "B"]
    assert [t for z, t in html_text.page_blocks(page) if z == "open"] == ["Site", "other"]


@pytest.mark.parametrize("page", ["", "plain text", "<", "<p", "a < b > c", "<article>", "<nav>never closed <article><p>x",
                                  "<p>" * 5000, "<a href=\"never>closed <p>x", "&am", "<script>open", "</div></article>x"])
def test_main_text_takes_any_page(page):
    assert all(t == " ".join(t.split()) and t for _, t in html_text.page_blocks(page))


def test_main_text_open_pages_lose_repeated_runs(spark):
    menu = "home about contact products services careers press legal imprint sitemap"
    own = [" ".join(f"p{i}w{k}" for k in range(9)) for i in range(5)]
    rows = [(i, f"http://h.example/{i}", f"<body><div>{menu}</div><div>{own[i]}</div></body>") for i in range(5)]
    rows += [(10, "http://other.example/1", f"<body><div>{menu}</div></body>"), (11, None, None), (12, "nonsense", ""),
             (None, "http://h.example/9", "<main><p>kept</p></main>"), (13, "http://h.example/x", "<div>short</div>"),
             (14, "http://h.example/y", "<article>" + "<p>long text</p>" * 20_000 + "</article>")]
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.main_text(pages(spark, rows)).collect()}
    for i in range(5):
        assert got[i][0] == own[i]
    assert got[10][0] == menu and got[11] == ("", 0) and got[12] == ("", 0) and got[None] == ("kept", 4)
    assert got[13][0] == "short" and got[14][1] == 20_000 * 10 - 1
    assert html_text.main_text(pages(spark, rows).limit(0)).count() == 0


def test_main_text_of_table(spark):
    got = {r.page_id: r.text for r in queries.QUERIES["op3_html_text"](spark, SF01).collect()}
    for r in spark.read.parquet(f"{SF01}/pages.parquet").collect():
        body = re.search(r"<article>(.*)</article>", r.html, re.S)[1].replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert got[r.page_id] == "\n".join(x for x in blocks if x)


# --- licenses ----------------------------------------------------------------------------

def brute_license(text, threshold=license_scan.THRESHOLD):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    text = (text or "").translate(LOWER)
    w, places, base, labels, best = word.findall(text), [], set(), set(), 0.0
    for phrase, label in license_scan.BASE.items():
        p = phrase.split()
        for k in range(len(w) - len(p) + 1):
            if w[k:k + len(p)] == p:
                places.append(k)
                base.add(label)
    for line in text.split("\n"):
        own = word.findall(line)
        for label, template in license_scan.TEMPLATES:
            t = set(template.split())
            starts = range(0, max(1, len(own) - license_scan.WINDOW + 1))
            share = max(len(t & set(own[k:k + license_scan.WINDOW])) / len(t) for k in starts)
            if share >= threshold:
                labels.add(label)
                best = max(best, share)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), labels | base, best


def test_license_scan_against_all_blocks(spark):
    texts = [r.text for r in spark.read.parquet(f"{SF01}/documents.parquet").select("text").limit(200).collect()]
    texts += [None, "", "mit", "MIT License mit\nlicense", "the Mİt license", "apache  license, MIT-license (general public\nlicense)",
              "Licensed under CC BY-NC 4.0.", "Licensed under CC BY 4.0.", "licensed  Under the\tMIT", "xmit license mitlicense"]
    texts += [t for _, t in license_scan.TEMPLATES] + [" ".join(t.split()[1:]) for _, t in license_scan.TEMPLATES]
    rows = list(enumerate(texts))
    got = {r.doc_id: r for r in license_scan.license_scan(docs(spark, rows)).collect()}
    for i, t in rows:
        n, k, a, b, base, labels, best = brute_license(t)
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (n, k, a, b, base), t
        assert set(filter(None, r.labels.split(","))) == labels and abs(r.score - (1.0 if k else best)) < 1e-12, t
    assert license_scan.license_scan(docs(spark, rows).limit(0)).count() == 0


def test_license_in_a_very_long_line(spark):
    notice = license_scan.TEMPLATES[2][1]
    for pad in (0, 30, 63, 95, 500):
        text = "w " * pad + notice + " w" * 700
        assert license_scan.license_scan(docs(spark, [(1, text)])).first().labels == "mit"


# --- WARC --------------------------------------------------------------------------------

def test_warc_round_trip_odd_rows(spark):
    rows = [(1, "http://a/ü?x=%20", "<p>ä</p>"), (2, None, "<p>ä</p>"), (9, "http://b\r\nX: y", "<p>ä</p>"), (3, "u", None),
            (4, "u", ""), (5, "u", "z" * 300_000), (None, "u", "n"), (None, "v", "<p>ä</p>"), (6, "u", "WARC/1.1\r\n\r\nfake"),
            (7, "u", "r"), (7, "u", "r")]
    got = sorted(((r.page_id or 0, r.target_uri or "", r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)
                  for r in warc.warc_round_trip(pages(spark, rows)).collect()), key=str)

    def want(i, url, text, kind, to):
        b = (text or "").encode()
        return i or 0, url or "", len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), kind, to

    expected = [want(*rows[0], "revisit", 9), want(*rows[1], "revisit", 9), want(*rows[2], "response", None),
                want(*rows[3], "revisit", 4), want(*rows[4], "response", None), want(*rows[5], "response", None),
                want(*rows[6], "response", None), want(*rows[7], "revisit", 9), want(*rows[8], "response", None),
                want(*rows[9], "response", None), want(*rows[10], "response", None)]
    assert got == sorted(expected, key=str)
    assert warc.warc_round_trip(pages(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("split", [1, 7, 100, 5000])
def test_warc_ranges_own_each_record_once(tmp_path, split):
    import pyarrow as pa
    r = random.Random(split)
    payloads = [bytes(r.randrange(256) for _ in range(r.randrange(400))) + warc.MAGIC * 3 for _ in range(12)]
    data = b"".join(warc.member(i, None, p, None, False) for i, p in enumerate(payloads))
    found = []
    for a in range(0, len(data), split):
        with pa.BufferReader(data) as source:
            found += [(at, warc.parsed(rec)) for at, rec in warc.range_members(source, a, min(a + split, len(data)))]
    assert [p for _, (_, p) in found] == payloads and len({at for at, _ in found}) == len(payloads)
    with gzip.open(io.BytesIO(data)) as whole:
        assert whole.read().count(b"WARC/1.1\r\n") == len(payloads)


# --- quality -----------------------------------------------------------------------------

def test_quality_held_out_accuracy(spark):
    import zlib
    sf = "/root/testdata/sf0.1"
    got = queries.QUERIES["op8_quality"](spark, sf).toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    held = got[got.held_out].merge(labels, on="doc_id")
    assert (held.predicted == held.quality).mean() > 0.97
    good = held[held.quality == 1]
    assert (good.predicted == 1).mean() > 0.99


def test_quality_odd_rows(spark):
    rows = [(i, "good words here and there, as one would write them. " * (1 + i % 3) if i % 2 else "### $$$ !!! " * (1 + i % 4))
            for i in range(60)] + [(100, None), (101, ""), (None, "a"), (102, "x" * 500_000), (102, "y")]
    labels = spark.createDataFrame([(i, i % 2, None, 0) for i in range(60)] + [(1, 0, None, 0), (None, 1, None, 0), (5, None, None, 0)],
                                   "doc_id long, quality int, text string, score int")
    got = quality_gam.quality_scores(docs(spark, rows), labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.predicted for r in got}
    assert all(by[i] == i % 2 for i in range(60))
    assert {r.score for r in quality_gam.quality_scores(docs(spark, rows), labels.limit(0)).collect()} == {0.5}
    assert quality_gam.quality_scores(docs(spark, rows).limit(0), labels).count() == 0
    kept = quality_gam.keep_quality(docs(spark, rows), labels)
    assert kept.columns == ["doc_id", "text", "key", "row"] and kept.where("doc_id < 60").count() == 30


def test_quality_model_is_additive():
    rng = np.random.default_rng(0)
    x = rng.random((2000, len(quality_gam.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)  # an interaction only
    model = quality_gam.fit(x, y)
    assert (1, 0) in model.pairs and ((model.scores(x) > 0.5) == y).mean() > 0.9


def test_directions_are_fitted_on_all_documents(spark, monkeypatch):
    """no document is left out of the fit; products of terms give what passages give."""
    seen, real = [], decontaminate.latent_directions

    def fitted(tokens, items, weight=1.0, **kw):
        seen.append(tokens.count())
        out = real(tokens, items, weight, **kw)
        monkeypatch.setattr(decontaminate, "GRAM_TERMS", 0)
        plain = real(tokens, items, weight, **kw)
        monkeypatch.setattr(decontaminate, "GRAM_TERMS", 4096)
        assert np.abs(np.abs(out.T @ plain) - np.eye(out.shape[1]))[:4, :4].max() < 1e-3
        return out
    monkeypatch.setattr(decontaminate, "latent_directions", fitted)
    rows = [(i, f"w{i % 97} word{i % 31} tale{i % 13} of the sea number{i % 7} and w{i % 89}") for i in range(10_400)]
    items = [(j, " ".join(f"w{(j * 11 + k) % 97} tale{(j + k) % 13} word{(j * 3 + k) % 31}" for k in range(12))) for j in range(6)]
    decontaminate.contaminated(docs(spark, rows), benchmark(spark, items)).count()
    assert seen == [10_400]
