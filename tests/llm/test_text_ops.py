"""Operators on single texts and pages against brute force, with the defined edge cases."""

import base64
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from canopy.llm import bpe, html, merkle, pii, quality, substrings, toxicity, warc

CLASH = "doc_id long, text string, _row long, node long, start int, score double, n int"


@pytest.fixture(scope="module")
def make(spark):
    def build(texts, ids=None):
        ids = ids if ids is not None else range(len(texts))
        return spark.createDataFrame([(i, t, 1, 2, 3, 4.0, 5) for i, t in zip(ids, texts)], CLASH)

    return build


@pytest.fixture(scope="module")
def ranks():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.tiktoken")


def test_bpe_equals_the_library(ranks):
    import public_tokenizers
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    rng = random.Random(3)
    signs = ["'", "s", "t", "re", "ll", " ", "  ", "\n", "a", "É", "5", "½", "!", "'ve", " ", "漢", "😀", "\x00", "\x1c", "\x85", "<|endoftext|>"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(30))) for _ in range(3000)]
    texts += ["", "a'real's", "x" * 3000, "!?" * 500, " " * 100, "ab c" * 2000]
    raw = [t.encode() for t in texts]
    counts, ids, offsets = bpe.encode_texts(raw, ranks)
    assert bpe.decode_ids(counts, ids, offsets, ranks) == raw
    at = 0
    for text, n in zip(texts, counts.tolist()):
        assert ids[at : at + n].tolist() == library.encode_ordinary(text)
        at += n


def test_bpe_edge_rows(make, ranks):
    docs = make(["one two", "", None, "one two", "é" * 50], [3, 4, None, 3, 9])
    rows = {(r.doc_id, r.n_tokens, r.decoded_sha256) for r in bpe.round_trip(docs, ranks).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert (4, 0, empty) in rows and (None, 0, empty) in rows and len(rows) == 4
    assert bpe.round_trip(docs, ranks).count() == 5
    assert bpe.round_trip(docs.limit(0), ranks).count() == 0


def test_transition_scan_does_not_depend_on_blocks(monkeypatch):
    import numpy as np

    symbols = np.random.default_rng(1).integers(0, 9, 5000).astype(np.uint8)
    whole = bpe.boundaries(symbols)
    state, want = bpe.START, []
    for s in symbols:
        want.append(bool(bpe.CUT[s, state]))
        state = bpe.STEP[s, state]
    assert whole.tolist() == want
    monkeypatch.setattr(bpe, "BLOCK", 7)
    assert bpe.boundaries(symbols).tolist() == want


def test_fingerprints(make, spark):
    texts = ["One. Two! Three?\nFour, five.\n\nSix.", "", None, "One. Two! Three?\nFour, five.\n\nSix.", "x" * 500]
    rows = {r.doc_id: r for r in merkle.compare_edited(make(texts, [1, 2, 3, 4, 5])).collect()}
    plain = [t or "" for t in texts]
    for k, text in enumerate(plain):
        n, after = len(text), plain[(k + 1) % 5]
        edited = text[: n - n // 2] + after[: n // 2]
        assert rows[k + 1].n_chars == n and rows[k + 1].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    assert rows[1].fingerprint == rows[4].fingerprint != rows[5].fingerprint and rows[2].near_next == 1.0
    assert all(0 <= r.near_edited <= 1 for r in rows.values())
    both = spark.createDataFrame([("A one.\nB two.\nC three.", "A one.\nB other.\nC three.")], "a string, b string")
    prints = both.select(merkle.fingerprint(F.col("a")).alias("a"), merkle.fingerprint(F.col("b")).alias("b"))
    assert prints.select(merkle.edited_paragraphs(F.col("a"), F.col("b"))).first()[0] == [1]
    assert merkle.compare_edited(make(["alone"])).first().near_next == 1.0
    assert merkle.compare_edited(make([])).count() == 0
    assert merkle.compare_edited(make(["b", "a", "c"], [7, 7, None])).count() == 3


def test_fingerprint_tree_is_that_of_the_text(spark):
    tree = [[["One. ", "Two!\n"], ["Three, four.\n\n"]], [["Five six. ", "x" * 40, "x" * 20]]]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    sections, printed = [], []
    for section in tree:
        nodes = [("".join(map(sha, leaves)), leaves) for leaves in section]
        digest = sha("".join(sha(joined) for joined, _ in nodes))
        sections.append(digest)
        printed.append(digest[:16] + ";" + ";".join(sha(joined)[:12] + "." + ".".join(sha(x)[:8] for x in leaves) for joined, leaves in nodes))
    text = "".join(x for section in tree for leaves in section for x in leaves)
    got = spark.createDataFrame([(text,)], "t string").select(merkle.fingerprint(F.col("t"))).first()[0]
    assert got == sha("".join(sections)) + "/" + "/".join(printed)


def test_pii(make):
    card, mail = "4111111111111111", "a.b@mail.co.uk"
    docs = make([f"Frau Anna Weber, {card} at 10.0.0.1", f"{mail} {card}", "", None, f"{mail} {card}", "plain 4.0 text."])
    rows = [r for r in sorted(pii.pseudonymized(docs, counter="k").collect(), key=lambda r: r.doc_id)]
    assert rows[2].text == "" and rows[3].text is None and rows[5].text == "plain 4.0 text." and rows[1].text == rows[4].text
    assert [r.k for r in rows] == [3, 2, 0, 0, 2, 0] and rows[0].score == 4.0
    assert card not in rows[0].text and rows[0].text.startswith("Frau ") and len(rows[0].text) == len(docs.first().text)
    number = rows[1].text.split()[1]
    assert number in rows[0].text and rows[1].text.split()[0].endswith(".uk")
    digits = [int(d) for d in reversed(number)]
    assert sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(digits)) % 10 == 0
    assert all(0 <= int(o) <= 255 for o in rows[0].text.split()[-1].split("."))
    assert pii.pseudonymized(docs.limit(0)).count() == 0


def test_pii_formats(make):
    formats = ["+14155552671", "+442079460958", "415-555-2671", "415.555.2671", "(415)-555-2671", "415 555 2671", "1-415-555-2671", "030 1234567", "0171/1234567", "01 23 45 67 89"]
    formats += ["+1 (415) 555-2671", "3782 822463 10005", "4111 1111 1111 1111", "378282246310005", "DE89 3704 0044 0532 0130 00", "GB29NWBK60161331926819", "NO93 8601 1117 947"]
    formats += ["2001:db8::ff00:42:8329", "2001:0db8:0000:0000:0000:ff00:0042:8329", "fe80::1", "::1", "dead::beef", "10.20.30.40"]
    around = ["call {} now", "({})", "{}", "a: {}, b", "x\n{}.\n"]
    texts = [a.format(f) for f in formats for a in around]
    got = [r for r in sorted(pii.pseudonymized(make(texts), counter="k").collect(), key=lambda r: r.doc_id)]
    for (f, a), r in zip([(f, a) for f in formats for a in around], got):
        before, after = a.split("{}")
        new = r.text[len(before) : len(r.text) - len(after)]
        assert r.k == 1 and r.text == before + new + after and new != f and len(new) == len(f), (f, a, r.text)
        assert "".join("9" if c.isdigit() else c for c in new) == "".join("9" if c.isdigit() else c for c in f) or any(c.isalpha() for c in f)
        if f.startswith(("DE", "GB", "NO")):
            plain = new.replace(" ", "")
            assert new[:2] == f[:2] and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1
    still = ["at 12:30:45 on 01-02-2024", "std::cout << a", "version 4.0, 1234567 items, 2024-05-06", "a 10-20 b"]
    assert [r.text for r in sorted(pii.pseudonymized(make(still)).collect(), key=lambda r: r.doc_id)] == still


def test_pii_names_agree_by_word(make):
    docs = make(["Mr John Smith came. Mr Smith left; Smith and John, not Smithson.", "Prof. Dr. Weber met Mrs Smith.", "Smith stands alone."])
    one, two, three = [r.text for r in sorted(pii.pseudonymized(docs).collect(), key=lambda r: r.doc_id)]
    john, smith = one.split(" came")[0].split()[1:]
    assert one == f"Mr {john} {smith} came. Mr {smith} left; {smith} and {john}, not Smithson." and "Smith" != smith and "John" != john
    assert two.startswith("Prof. Dr. ") and two.endswith(f" met Mrs {smith}.") and "Weber" not in two and three == "Smith stands alone."


def test_surrogates_stay_distinct_where_the_format_is_narrow(spark):
    found = spark.createDataFrame([(f"{a}.{b}.{c}.{d}",) for a in range(1, 5) for b in range(1, 5) for c in (1, 2) for d in range(1, 10)], "entity string")
    table = pii.surrogates(found, "k").collect()
    assert len({r.surrogate for r in table}) == found.count() and not {r.surrogate for r in table} & {r.entity for r in table}


def test_surrogates_widen_a_full_format(spark):
    names = [a + b for a in "BCDFGHJKLMNPQRSTVWXYZ" for b in "aeo"]
    ips = [f"1.1.{c}.{d}" for c in range(1, 10) for d in range(1, 10)] + [f"{a}.{b}.{c}.{d}" for a in range(1, 10) for b in range(1, 10) for c in range(1, 10) for d in range(2, 9)]
    mails = [a + "@b.co" for a in "abcdefghijklmnopqrstuvwxyz"] + [a + "@" + b + ".co" for a in "aeiou" for b in "cdfghjklmnpqrstvwxyz"]
    found = spark.createDataFrame([(e,) for e in sorted({*names, *ips, *mails})], "entity string")
    table = pii.surrogates(found, "k").collect()
    assert len(table) == found.count() == len({r.surrogate for r in table}) and not {r.surrogate for r in table} & {r.entity for r in table}
    assert all(r.surrogate.endswith(".co") for r in table if r.kind == "email") and all(r.surrogate[-1] == r.entity[-1] for r in table if r.kind == "name")
    assert all(all(0 <= int(o) <= 255 for o in r.surrogate.split(".")) for r in table if r.kind == "ip")


PAGE = "<html><head><title>t</title></head><body><nav><a href='/'>Home</a></nav>{}<footer>f</footer></body></html>"


def test_html_parser():
    page = html.parse_page(PAGE.format("<article><h1>A &amp; b</h1><p>one<b>x</b>\n two<br>three<p>four<script>var a='</p>'</script><div class='comments'>no</div></article>"))
    assert [t for t, main, noise, _ in page.blocks if main and not noise] == ["A & b", "onex two", "three", "four"]
    page = html.parse_page("<body><header>site</header><p>a</p></body>")
    assert [t for t, _, noise, _ in page.blocks if not noise] == ["a"]
    page = html.parse_page("<body><article><header><h1>Title</h1></header>a</article></body>")
    assert [t for t, main, noise, _ in page.blocks if main and not noise] == ["Title", "a"]
    for odd in ("", "<", "<p", "a<b", "</p></div>", "<ul><li>x<li>y</ul>z", "<!-- open", "&#x41;&am"):
        html.parse_page(odd)


def test_html_names_do_not_reach_articles():
    def text(body):
        return html.page_text(html.parse_page(PAGE.format(body)), set())

    assert text("<div class='page has-sidebar'>pre<article><h1>T</h1><p>a</p></article></div>") == "T a"
    assert text("<div class='promo-layout'>pre<main>a</main></div>") == "a"
    assert text("<div class='page has-sidebar'><p>a</p><div class='sidebar'>no</div></div>") == "a"
    assert text("<article><header class='entry-header'><h1>T</h1></header><div class='article-header'>b</div><p>a</p></article>") == "T b a"
    assert text("<article><div class='related-work'>r</div><div class='copyright-notice'>c</div><h2 class='section-header'>S</h2>a</article>") == "r c S a"
    assert text("<div class='post-header'><h1>T</h1></div><h2 class='header'>S</h2><p>a</p>") == "T S a"
    assert text("<article>a<div class='ad'>no</div><div id='comments'>no</div><div class='x newsletter-form'>no</div></article>") == "a"
    assert text("<article>a</article><div class='related-posts'><article>no</article></div>") == "a"
    assert text("<div class='ad'>no</div><div class='site-header'>no</div><div class='main-menu'>no</div><p>a</p>") == "a"


def test_html_templates_go(spark):
    bodies = [f"<div>Our site offers</div><p>text {k}</p>" for k in range(6)]
    rows = [(k, "http://h.example/x", PAGE.format(b)) for k, b in enumerate(bodies)]
    rows += [(10, None, None), (11, "http://h.example/y", ""), (12, "odd url", PAGE.format("<article>kept</article>")), (12, "odd url", PAGE.format("<article>kept</article>"))]
    pages = spark.createDataFrame([(*r, 0, "x") for r in rows], "page_id long, url string, html string, host int, outer string")
    got = sorted((r.page_id, r.text, r.n_chars) for r in html.extract(pages, min_pages=5).collect())
    assert got == [*((k, f"text {k}", 6) for k in range(6)), (10, "", 0), (11, "", 0), (12, "kept", 4), (12, "kept", 4)]
    few = {r.page_id: r.text for r in html.extract(pages, min_pages=7).collect()}
    assert few[0] == "Our site offers text 0"
    assert html.extract(pages.limit(0)).count() == 0


def test_html_templates_go_inside_articles(spark):
    box = "<div class='box'><p>More from us</p></div>"
    bodies = [f"<article><h1>T{k}</h1><p>text {k}</p>{box}</article><div>out {k}</div>" for k in range(6)]
    bodies += [f"<article>{box}</article><div>out {k}</div>" for k in (6, 7)]
    bodies += ["<article></article><div>out 8</div>"]
    pages = spark.createDataFrame([(k, "http://h.example/x", PAGE.format(b)) for k, b in enumerate(bodies)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.extract(pages).collect()}
    assert got == {**{k: f"T{k} text {k}" for k in range(6)}, 6: "out 6", 7: "out 7", 8: ""}


def test_html_templates_are_a_share_of_the_site(spark):
    box = "<div>Our site offers</div>"
    copied = "<p>a text that was copied</p>"
    rows = [("big", f"<p>own {k}</p>" + box * (k % 4 != 0)) for k in range(40)] + [("big", f"<p>six</p><p>more {k}</p>") for k in range(6)]
    rows += [("big", copied + f"<div class='ad'>{k}</div>") for k in range(60)]
    rows += [("small", f"<p>s {k}</p>" + box) for k in range(3)] + [("two", f"<p>t {k}</p>" + box) for k in range(2)]
    pages = spark.createDataFrame([(k, f"http://{host}.example/", PAGE.format(b)) for k, (host, b) in enumerate(rows)], "page_id long, url string, html string")
    got = [r.text for r in sorted(html.extract(pages).collect(), key=lambda r: r.page_id)]
    want = [f"own {k}" for k in range(40)] + [f"six more {k}" for k in range(6)] + ["a text that was copied"] * 60
    assert got == want + [f"s {k}" for k in range(3)] + [f"t {k} Our site offers" for k in range(2)]


def test_warc_round_trip(spark):
    long = "é" * 60
    rows = [(1, "http://a", long), (2, "http://b", long), (3, None, "short"), (4, "http://c", "short"), (5, "http://d", None), (2, "http://b", long), (None, "http://e", long), (6, "x", "WARC/1.1\r\n\r\n" * 20)]
    pages = spark.createDataFrame([(*r, 7) for r in rows], "page_id long, url string, html string, digest int")
    got = sorted(((r.page_id or -1), r.record_type, r.refers_to, r.payload_bytes, r.payload_digest, r.url) for r in warc.round_trip(pages).collect())
    want = []
    for page, url, text in rows:
        body = (text or "").encode()
        again = text == long and page != 1
        want.append((page or -1, "revisit" if again else "response", 1 if again else None, len(body), hashlib.sha256(body).hexdigest(), url))
    assert got == sorted(want, key=lambda r: tuple((x is not None, x) for x in r)) or sorted(got, key=repr) == sorted(want, key=repr)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_assembly_joins_what_belongs_together(spark):
    rows = [("response", "r1", None), ("request", "q1", "r1"), ("metadata", "m1", "r1"), ("revisit", "r2", None), ("request", "q2", "r2"), ("request", "q3", "gone")]
    names = [f.split()[0] for f in warc.RECORD.split(", ")]
    records = spark.createDataFrame([(k, i, c, None, None, 1, None, None, None, None) for k, i, c in rows], warc.RECORD).select(*names)
    got = {r.capture_id: (r.request and r.request.record_id, r.metadata and r.metadata.record_id) for r in warc.assemble(records).collect()}
    assert got == {"r1": ("q1", "m1"), "r2": ("q2", None)}


def test_chunks_resist_shifts():
    rng = random.Random(5)
    text = bytes(rng.choice(b"abcdefgh ") for _ in range(20_000))

    def pieces(t):
        cuts = substrings.cut_points(t)
        return {t[a:b] for a, b in zip([0, *cuts], cuts)}

    moved = pieces(b"some words put in front " + text)
    assert len(pieces(text) - moved) <= 2
    c = substrings.cut_points(text)
    sizes = [b - a for a, b in zip([0, *c], c)]
    assert c[-1] == len(text) and max(sizes) <= substrings.LONGEST and min(sizes[:-1]) >= substrings.SHORTEST
    assert substrings.cut_points("é".encode() * 400)[-1] == 800 and substrings.cut_points(b"a") == [1]


def test_repeated_passages(make):
    rng = random.Random(6)
    words = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    passage = words(60)
    texts = [words(80) + " " + passage + " " + words(50), words(30), words(10) + " é " + passage + " " + words(5), "", None, words(30)]
    docs = make([*texts, texts[1]], [5, 1, 9, 2, 3, None, 1])
    found = substrings.repeated_spans(docs).collect()
    assert [(r.doc_id, r.first_doc_ids) for r in found] == [(9, [5])]
    # The whole passage, and the spaces that stand around it in both texts.
    assert texts[2][found[0].start : found[0].end].strip() == passage
    unique = docs.where("doc_id <> 1")
    cut = {r.doc_id: r.text for r in substrings.without_spans(unique, substrings.repeated_spans(docs)).collect()}
    assert cut[9] == texts[2][: found[0].start] + texts[2][found[0].end :] and cut[5] == texts[0]
    assert substrings.repeated_spans(docs.limit(0)).count() == 0


@pytest.mark.parametrize("words", [51, 60, 80])
def test_planted_passages_are_found_whole(make, words):
    rng = random.Random(words)
    some = lambda n: " ".join("".join(rng.choice("aeioulnrstdé") for _ in range(rng.randrange(2, 10))) for _ in range(n))
    passages = [some(words) for _ in range(300)]
    texts = [f"{some(rng.randrange(3, 40))} {p} {some(rng.randrange(3, 40))}" for p in passages for _ in range(2)]
    found = {}
    for r in substrings.repeated_spans(make(texts)).collect():
        found.setdefault(r.doc_id, []).append((r.start, r.end, r.first_doc_ids))
    caught, cover, beyond = 0, 0.0, 0
    for k, passage in enumerate(passages):
        begin = texts[2 * k + 1].index(passage)
        spans = [(a, b) for a, b, firsts in found.get(2 * k + 1, []) if firsts == [2 * k]]
        inside = sum(max(0, min(b, begin + len(passage)) - max(a, begin)) for a, b in spans)
        caught += bool(spans)
        cover += inside / len(passage)
        beyond += sum(b - a for a, b in spans) - inside
    assert caught >= 0.99 * len(passages) and cover >= 0.95 * len(passages)
    assert beyond <= 6 * len(passages)  # the spaces around, and letters that happen to agree
    assert not any(k % 2 == 0 for k in found)


def labelled(make, spark, bad, column):
    rng = random.Random(7)
    clean = lambda: " ".join(rng.choice("the of and stone river light tree under walk slow".split()) for _ in range(rng.randrange(5, 60)))
    texts, labels = [], []
    for k in range(300):
        rotten = k % 3 == 0
        texts.append(bad(clean()) if rotten else clean())
        labels.append((k, int(rotten == (column == "toxic")), 0))
    return make(texts), spark.createDataFrame(labels, f"doc_id long, {column} int, lang int")


def test_toxicity(make, spark):
    docs, labels = labelled(make, spark, lambda t: t + " you vile grubber " + t[:20], "toxic")
    tagger = toxicity.fit(docs, labels)
    rows = {r.doc_id: r for r in toxicity.score_documents(docs, tagger).collect()}
    assert all(rows[k].predicted == int(k % 3 == 0) for k in rows if rows[k].held_out)
    text = docs.where("doc_id = 3").first().text
    assert any("vile" in text[s.start : s.end] for s in rows[3].spans)
    odd = toxicity.score_documents(make(["", None, "İ vile grubber", "stone " * 20_000], [1, None, 2, 2]), tagger).collect()
    assert all(0 <= r.score <= 1 for r in odd) and {r.doc_id: r.held_out for r in odd}[None]
    assert toxicity.score_documents(docs, toxicity.fit(docs, labels.limit(0))).first().score == 0.5
    kept = toxicity.without_toxic(docs, tagger)
    assert kept.columns == docs.columns and kept.count() == 200 and toxicity.without_toxic(docs.limit(0), tagger).count() == 0


def test_marginals_equal_enumeration():
    import itertools

    import numpy as np

    rng = np.random.default_rng(2)
    field = toxicity.Field(np.zeros(1), rng.normal(size=(2, 2)))
    lengths = np.array([3, 0, 5, 1])
    scores = rng.normal(size=9) * 2
    got, at = field.marginals(scores, lengths), 0
    for n in lengths:
        s = scores[at : at + n]
        total, on = 0.0, np.zeros(n)
        for path in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(sum(s[t] * path[t] for t in range(n)) + sum(field.moves[path[t - 1], path[t]] for t in range(1, n)))
            total += w
            on += w * np.array(path)
        if n:
            assert np.allclose(got[at : at + n], on / total)
        at += n


def test_quality(make, spark):
    docs, labels = labelled(make, spark, lambda t: t.replace(" ", "## "), "quality")
    scorer = quality.fit(docs, labels)
    rows = quality.score_documents(docs, scorer).collect()
    assert all(r.predicted == int(r.doc_id % 3 != 0) for r in rows if r.held_out)
    odd = quality.score_documents(make(["", None, "a", "x" * 3_000_000], [1, None, 2, 2]), scorer).collect()
    assert len(odd) == 4 and all(0 <= r.score <= 1 for r in odd)
    assert quality.score_documents(docs, quality.fit(docs, labels.limit(0))).first().score == 0.5


def test_network_pools_the_whole_text(monkeypatch):
    import numpy as np

    net, text = quality.Network(), bytes(random.Random(1).choices(range(256), k=3000))
    whole = net.features(text)
    monkeypatch.setattr(quality, "PASS_BYTES", 256)
    assert np.allclose(whole, net.features(text), atol=1e-6)
    assert np.isfinite(net.features(text[:1])).all()
