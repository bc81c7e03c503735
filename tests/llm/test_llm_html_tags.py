"""Tags that never end, letters that change their length in lower case, and the choice of the zone."""

import random
import time

import pytest

from tagspace.llm import html_text


def text(page):
    blocks = html_text.page_blocks(page)
    return "\n".join(t for z, t in blocks if z in html_text.content_zones(blocks))


def test_letters_that_grow_in_lower_case():
    page = "<main><p>" + "İ" * 12 + "</p><title>no</title><script>x</script><p>first</p><style>y</STYLE><p>second</p></main>"
    assert text(page) == "İ" * 12 + "\nfirst\nsecond"


@pytest.mark.parametrize("page", ["<a" * 500_000, "<a " * 300_000 + ">", "<a \"" * 250_000, "<!--" * 250_000, "</" * 500_000,
                                  "<div class='nav'>" * 16_000, "<script>" * 60_000, "<a '>" * 200_000, "<p>x" * 200_000])
def test_hostile_pages_take_linear_time(page):
    begin = time.process_time()
    html_text.page_blocks(page)
    assert time.process_time() - begin < 5


def test_comments_and_ends():
    assert text("<main><p>a<!-- <p>no</p> --><p>b</main>") == "a\nb"
    assert text("<main><p>a</p><!-- never closed <p>no</p></main>") == "a"
    assert text("<main><p>1 < 2 and 3 > 2</p></main>") == "1 < 2 and 3 > 2"


def test_zone_by_amount_of_text():
    page = "<main><h1>Headline</h1><p>a body of many words</p><article>card</article></main>"
    assert text(page) == "Headline\na body of many words\ncard"
    assert text("<main><p>more</p><article><p>the article itself</p></article></main>") == "the article itself"
    assert html_text.content_zones([("open", "x"), ("furniture", "y")]) == set()


def test_runs_decide_inside_content_too(spark):
    notice = "we use small files to measure visits and to show adverts please agree"
    shared = "a sentence of nine words that several articles share"
    own = [" ".join(f"p{i}w{k}" for k in range(30)) for i in range(5)]
    part = notice + " or read on"
    rows = [(i, f"http://h.example/{i}", f"<article><p>{own[i]}</p><p>{shared}</p></article><footer>{notice}</footer>") for i in range(3)]
    rows += [(3, "http://h.example/3", f"<main><p>{own[3]}</p><p>{notice}</p><p>{shared}</p><p>short</p></main>"),
             (4, "http://h.example/4", f"<main><p>{own[4]}</p><p>{part}</p></main>"),
             (5, "http://h.example/5", f"<div class=content><p>{notice}</p><p>short</p></div>"),
             (6, "http://other.example/6", f"<main><p>{own[3]}</p><p>{notice}</p></main>"),
             (7, "http://h.example/7", f"<article><p>{own[4]}</p><p>{notice}</p></article>"),
             (8, "http://h.example/8", f"<main><p>{own[4]}</p><p>{notice}</p><article>{notice}</article></main>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.main_text(pages).collect()}
    assert [got[i] for i in range(3)] == [f"{own[i]}\n{shared}" for i in range(3)]
    assert got[3] == f"{own[3]}\n{shared}\nshort"          # a notice from other pages' footers
    assert got[4] == f"{own[4]}\n{part}"                   # covered in part only
    assert got[5] == f"{notice}\nshort"                     # most of the content: a copy
    assert got[6] == f"{own[3]}\n{notice}"                  # another host
    assert got[7] == f"{own[4]}\n{notice}"                  # articles keep all their text
    assert got[8] == f"{own[4]}\n{notice}"                  # the article's one stays, the one beside it goes


@pytest.mark.parametrize("seed", range(3))
def test_runs_cover_what_common_extensions_cover(seed):
    """Brute force over a real suffix array: sorted suffixes, common extensions of PAGES distinct pages."""
    r = random.Random(seed)
    phrases = [[r.choice("abc") for _ in range(r.randint(3, 14))] for _ in range(4)]
    pages = [[w for _ in range(4) for w in r.choice(phrases) + [r.choice("xyz")] * r.randint(0, 2)] for _ in range(6)]
    suffixes = sorted((p[k:], n, k) for n, p in enumerate(pages) for k in range(len(p)))
    covered = [set() for _ in pages]
    for i in range(len(suffixes)):
        common, seen = len(suffixes[i][0]), set()
        for j in range(i, len(suffixes)):
            both = zip(suffixes[i][0], suffixes[j][0])
            common = min(common, next((k for k, (x, y) in enumerate(both) if x != y), min(len(suffixes[i][0]), len(suffixes[j][0]))))
            if common < html_text.RUN:
                break
            seen.add(suffixes[j][1])
            if len(seen) >= html_text.PAGES:
                for _, n, k in suffixes[i:j + 1]:
                    covered[n].update(range(k, k + common))
    runs = [set(html_text.run_hashes([" ".join(p)]).tolist()) for p in pages]
    repeated = {h for p in runs for h in p if sum(h in q for q in runs) >= html_text.PAGES}
    for p, c in zip(pages, covered):
        assert html_text.unique_runs([" ".join(p)], repeated) == " ".join(w for k, w in enumerate(p) if k not in c)
