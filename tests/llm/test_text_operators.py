"""Operators that work on one text at a time, against brute force, round trips and held-out accuracy."""

import hashlib
import random
import re
import unicodedata

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm import bpe, entry, html_text, langid, packing, pii, secrets

SF, SMALL = "/root/testdata/sf0.01", "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", " ", "\n\t", "a", "é" * 5, "x" * 3000, "a b " * 2000, "<|endoftext|>", "don't  stop\r\n 12½ 中文 😀\x85\xa0z", "repeat", "repeat"]


def table(spark, texts, lang="en"):
    return spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t in enumerate(texts)], DOCS)


def clashing(spark, texts):
    """The same with extra columns whose names the operators use themselves."""
    names = ["id", "spans", "n", "key", "start", "words", "_digest", "row", "length", "_rank", "text_sha256"]
    return table(spark, texts).select("*", *(F.lit(1).alias(n) for n in names))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(PATH)
    t.no_truncation(), t.no_padding()
    return t


# -- secrets ---------------------------------------------------------------------------
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_secrets(text):
    text = text or ""
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return [(k, s, e) for s, _, k, e in sorted(out + [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24])]


def test_secrets_hold_the_base_spans(spark):
    rnd = random.Random(3)
    bits = ["password", "Token", "api_key", "APIKEY", "secret", "=", ":", " ", "'", '"', "AKIA", "ABCDEF0123456789", "deadbeef01234567", "é", "😀", "abc", "x.y-z/", "\n"]
    texts = ODD + ["".join(rnd.choice(bits) for _ in range(rnd.randint(1, 30))) for _ in range(300)] + ["token: token:abcdefgh", "a" * 24 + "g" + "0" * 30 + "😀secret = 'é"]
    for docs in (table(spark, texts), clashing(spark, texts)):
        for r in secrets.digests(docs).collect():
            base = base_secrets(texts[r["doc_id"]])
            assert r["base_sha256"] == sha(",".join(f"{k}:{s}:{e}" for k, s, e in base))
            assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(x[0] == k for x in base) for k in ("assign", "access", "hex"))
            assert set(f"{k}:{s}:{e}" for k, s, e in base) <= set(r["spans"].split(",")) or not base


def test_secrets_find_random_strings_and_leave_words(spark):
    rnd = random.Random(5)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    keys = ["x " + "".join(rnd.choice(letters) for _ in range(60)) + " y" for _ in range(30)]
    words = ["donaudampfschifffahrtsgesellschaft thisIsAVeryLongCamelCaseIdentifierName2", "some_snake_case_identifier_name_1 aaaaaaaaaaaaaaaaaaaaaaaaa1", "path/to/some/file/name2/index ABCDEFGHIJKLMNOPQRSTUVWXYZabcdef0"]
    got = {r["doc_id"]: r["spans"] for r in secrets.digests(table(spark, keys + words)).collect()}
    assert sum("random" in got[i] for i in range(30)) >= 27
    assert not any("random" in got[i] for i in range(30, 33))


def test_secrets_find_random_strings_in_paths(spark):
    rnd = random.Random(6)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    before = ["https://h.example/user-files/", "see deploy_key/", "X-Key/", "a/b-c+", ""]
    kinds = [letters] * 4 + [letters[26:52]]
    texts, spans = [], []
    for i in range(150):
        lead, key = before[i % 5], "".join(rnd.choice(kinds[i % 5]) for _ in range(60))
        texts.append(f"x {lead}{key} y")
        spans.append(f"random:{2 + len(lead)}:{62 + len(lead)}")
    words = ["some-path/to_the/file-name/of/an_index", "donaudampfschifffahrtsgesellschaft/kapitaen-x_y", "https://h.example/the-long_story/of_some-words/pneumonoultramicroscopicsilicovolcanoconiosis"]
    got = {r["doc_id"]: r["spans"] for r in secrets.digests(table(spark, texts + words)).collect()}
    assert all(sum(spans[i] == got[i] for i in range(k, 150, 5)) >= 24 for k in range(5))
    assert not any("random" in got[i] for i in range(150, 153))


ALPHABETS = {name: letters for name, _, letters in secrets.ENCODINGS}


def keys(rnd, alphabet, n, many):
    """Keys that their encoding's pattern takes, as a generator of such keys makes them."""
    pattern, out = {name: p for name, p, _ in secrets.ENCODINGS}[alphabet], []
    while len(out) < many:
        key = "".join(rnd.choice(ALPHABETS[alphabet]) for _ in range(n))
        if re.match(pattern, key):
            out.append(key)
    return out


def plain_statistics(body, alphabet):
    places = np.array([alphabet.index(c) + 1.0 for c in body])
    n, k = len(places), len(alphabet)
    counts = np.bincount(places.astype(int), minlength=k + 1)[1:]
    chi = ((counts - n / k) ** 2 / (n / k)).sum()
    above = places > k / 2
    up, runs = above.sum(), 1 + (above[1:] != above[:-1]).sum()
    mean = 2 * up * (n - up) / n + 1
    z_runs = (runs - mean) / np.sqrt((mean - 1) * (mean - 2) / (n - 1)) if 2 * up * (n - up) > n else 9.0
    r = np.corrcoef(places, np.roll(places, -1))[0, 1] if places.std() > 0 else None
    shares = [(1 - secrets.LETTER_NOISE) * p / sum(secrets.LETTERS) + secrets.LETTER_NOISE / 26 for p in secrets.LETTERS]
    kinds = [0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 for c in body]

    def text(swap):
        of, total = (1, 0, 2, 3) if swap else (0, 1, 2, 3), 0.0
        for i, c in enumerate(body):
            total += np.log(shares[ord(c.lower()) - 97] if c.isalpha() else 0.1 if c.isdigit() else 0.25)
            total += np.log(secrets.CHANGES[of[kinds[i - 1]]][of[kinds[i]]]) if i else np.log(0.25)
        return total

    return n, (chi - (k - 1)) / np.sqrt(2 * (k - 1) * (1 - 1 / n)), z_runs, 9.0 if r is None else (r + 1 / n) * np.sqrt(n), -n * np.log(k) - max(text(False), text(True))


def test_statistics_equal_a_plain_computation(spark):
    rnd = random.Random(8)
    bodies = [(k, a) for a in ("hex", "base62", "base64", "base32", "lower") for n in (20, 33, 70) for k in keys(rnd, a, n, 3)] + [("ab" * 12, "lower"), ("a" * 25, "lower"), ("ThisIsAName2" * 3, "base62")]
    rows = spark.createDataFrame([(i, b, ALPHABETS[a]) for i, (b, a) in enumerate(bodies)], "i int, body string, alphabet string")
    got = rows.select("i", secrets.statistics(secrets._characters(F.col("body"), F.col("alphabet")), F.length("alphabet").cast("double")).alias("s")).orderBy("i").collect()
    for r in got:
        assert np.allclose(tuple(r["s"]), plain_statistics(bodies[r["i"]][0], ALPHABETS[bodies[r["i"]][1]]), rtol=1e-6, atol=1e-6), bodies[r["i"]]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 3), st.integers(0, 30)), max_size=40))
def test_thresholds_equal_a_plain_rule(spark, pairs):
    rows = spark.createDataFrame([([{"band": b, "step": x} for b, x in pairs],)], "tests array<struct<band:int,step:int>>")
    expected = {}
    for band in {b for b, _ in pairs}:
        steps = sorted((x for b, x in pairs if b == band), reverse=True)
        accepted = [x for x in steps if 10 ** (-x / secrets.STEPS) <= secrets.FDR * sum(y >= x for y in steps) / len(steps)]
        if accepted:
            expected[band] = min(accepted)
    assert secrets._thresholds(rows) == expected


def test_recall_by_length_and_encoding(spark):
    """At least nine of ten keys of 24 and more characters among ordinary texts and names, and no name among them."""
    rnd = random.Random(12)
    names = [r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("text").collect()]
    names += ["org_springframework_context_support", "ThisIsAVeryLongCamelCaseIdentifierName2", "HTTP_STATUS_INTERNAL_SERVER_ERROR", "Rindfleischetikettierungsueberwachung", "INTERNATIONALIZATIONALIZED", "https://Host.example/Some/Long/Path2/To/The/Article", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdef0123456789", "AAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAA"]
    planted = [(a, n, k) for a in ("base62", "base64", "base64url", "base36", "BASE36", "base32", "HEX") for n in (24, 32, 40) for k in keys(rnd, a, n, 40)]
    texts = names + [f"see {k} here" for _, _, k in planted]
    found, got = {}, {r["doc_id"]: r["spans"] or "" for r in secrets.digests(table(spark, texts)).collect()}
    for i, (a, n, k) in enumerate(planted):
        found.setdefault((a, n), []).append(f"random:4:{4 + n}" in got[len(names) + i].split(",") or "access" in got[len(names) + i])
    assert all(sum(x) >= 0.9 * len(x) for x in found.values()), {k: sum(x) for k, x in found.items()}
    assert not any("random" in got[i] for i in range(len(names)))


def test_many_spans_in_one_text(spark):
    texts = [("0123456789abcdef" * 2 + " ") * 100_000, "token=abcdefgh0123 " * 50_000, "x" * 400_000, "AKIA" + "B" * 300_000]
    got = {r["doc_id"]: (r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in secrets.digests(table(spark, texts)).collect()}
    assert [got[i][:3] for i in range(4)] == [(0, 0, 100_000), (50_000, 0, 0), (0, 0, 0), (0, 1, 0)]
    assert all(got[i][3] == sha(",".join(f"{k}:{s}:{e}" for k, s, e in base_secrets(t))) for i, t in enumerate(texts))
    assert secrets.digests(table(spark, [])).count() == 0


def test_secrets_are_native(spark):
    plan = secrets.scan(table(spark, ["a"]))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_secrets_over_documents(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in entry.op1_secrets(spark, SMALL).collect():
        assert r["base_sha256"] == sha(",".join(f"{k}:{s}:{e}" for k, s, e in base_secrets(texts[r["doc_id"]])))


# -- byte pair encoding ----------------------------------------------------------------
def test_encoding_equals_the_library(tokenizer):
    own, rnd = bpe.encoder(PATH), random.Random(1)
    alphabet = [chr(c) for c in range(32, 127)] * 3 + list("\n\t\r  \x1c\x85\xa0 éÉßñ中文字한글😀👍́٣½Ⅷ'") + ["<|endoftext|>", "'s", "'ll", "  ", "aaaa", "0000", "----"]
    texts = [t for t in ODD if t] + ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))) for _ in range(3000)] + ["ab" * 2000, " " * 2000 + "x", "=" * 2000]
    for text in texts:
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids
        assert own.decode(ids) == tokenizer.decode(ids, skip_special_tokens=False) == text
        assert packing.token_ids(text, PATH).tolist() == ids


def test_decoding_of_any_ids(tokenizer):
    own, rnd = bpe.encoder(PATH), random.Random(2)
    for _ in range(500):
        ids = [rnd.randrange(50257) for _ in range(rnd.randint(0, 6))]
        assert own.decode(ids) == tokenizer.decode(ids, skip_special_tokens=False)


def test_a_small_cache_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3), monkeypatch.setattr(bpe, "CACHE_RUNS", 2)
    own, whole = bpe.TrieEncoder(PATH), bpe.encoder(PATH)
    for text in ("the cat sat", "on the mat", "the cat sat on"):
        assert own.encode(text) == whole.encode(text)


def test_round_trip_query(spark, tokenizer):
    for docs in (clashing(spark, ODD), spark.read.parquet(f"{SMALL}/documents.parquet")):
        texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
        rows = bpe.round_trip(docs, PATH).collect()
        assert len(rows) == len(texts)
        for r in rows:
            ids = tokenizer.encode(texts[r["doc_id"]], add_special_tokens=False).ids
            assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(texts[r["doc_id"]]))
    encoded = bpe.encode_documents(table(spark, ODD), PATH)
    assert {r["doc_id"]: r["text"] for r in bpe.decode_documents(encoded, PATH).collect()} == {i: t or "" for i, t in enumerate(ODD)}


# -- personal data ---------------------------------------------------------------------
def base_pii(text):
    text, out = text or "", []
    luhn = lambda d: sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0
    out += [(m.start(), 0, "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, "ip", m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, "card", m.end()))
    out += [(m.start(), 3, "phone", m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return [(k, s, e) for s, _, k, e in sorted(out)]


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(["a", "Z9", "@", ".", "com", "-", "+", "+1", "1", "22", "255", "256", "4111111111111111", "4111 1111 1111 1111", " ", "(", ")", "é", "_%", "1.2.3.4", "007", "\n"]), max_size=14))
def test_base_kinds_equal_the_patterns(parts):
    text = "".join(parts)
    assert [s for s in pii.find(text) if s[0] in pii.BASE_KINDS] == base_pii(text)


def test_added_kinds():
    kinds = lambda t: {k: t[s:e] for k, s, e in pii.find(t) if k not in pii.BASE_KINDS}
    assert kinds("IBAN: DE89 3704 0044 0532 0130 00 x") == {"iban": "DE89 3704 0044 0532 0130 00"}
    assert kinds("IBAN: DE88 3704 0044 0532 0130 00 x") == {}
    assert kinds("SSN: 123-45-6789, account no: 12345678, lives at 12 Main Street.") == {"ssn": "123-45-6789", "account": "12345678", "address": "12 Main Street"}
    assert kinds("https://bob:pw@example.com/x https://example.com/@y") == {"url_user": "bob:pw@example.com"}
    long = "221B " + "B" + "a" * 90 + " Saint Mary's Street"
    assert kinds(f"at {long}.") == {"address": long} and kinds("12,5 Main Street, 7 One Two Three Four Road, main Street") == {}
    assert kinds("on account of the street") == {}


def test_pii_query_and_redaction(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in pii.digests(docs).collect():
        base = base_pii(texts[r["doc_id"]])
        assert r["base_sha256"] == sha(",".join(f"{k}:{s}:{e}" for k, s, e in base))
        assert [r[f"n_{k}"] for k in pii.BASE_KINDS] == [sum(x[0] == k for x in base) for k in pii.BASE_KINDS]
    odd = clashing(spark, [*ODD, "mail a@b.co or +1 (743) 555-3824"])
    rows = {r["doc_id"]: r for r in pii.redact(odd).collect()}
    assert pii.redact(odd).columns == odd.columns
    assert rows[len(ODD)]["text"] == "mail [EMAIL] or [PHONE]" and rows[0]["text"] is None and rows[1]["text"] == ""
    assert pii.digests(table(spark, [])).count() == 0


# -- pages -----------------------------------------------------------------------------
def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_article_text(spark):
    html = '<body><div id="wrap" class="with-sidebar"><header><h1>Site</h1></header><div class="cookie-notice">We use</div><article><header><h1>T &amp; x</h1><p>by me</p></header><p>A<b>b</b> c&nbsp;d<br>e<p>two<ul><li>i1<li>i2</ul><form>f</form><div class="ad">AD</div><script>var t="</p>";</script><section id="comments"><p>nice</p></section></article><aside>s</aside><footer>f</footer></div>'
    rows = {r["page_id"]: r for r in html_text.extract(pages(spark, [(1, "http://h/1", html), (2, None, None), (3, "x", ""), (4, "http://h/2", "<p>only &lt;text&gt;"), (4, "http://h/2", "<p>only &lt;text&gt;")])).collect()}
    assert rows[1]["text"] == "T & x\n\nAb c d e\n\ntwo\n\ni1\n\ni2" and rows[1]["n_chars"] == len(rows[1]["text"])
    assert rows[2]["text"] == "" and rows[3]["n_chars"] == 0 and rows[4]["text"] == "only <text>"
    assert html_text.extract(pages(spark, [])).count() == 0


def test_slugs_inside_an_article_keep_its_text():
    kept = ['<h2 id="related-work">A</h2>', '<h2 id="comments">B</h2>', '<p id="notice-period">C</p>', '<section id="social-policy"><p>D</p></section>', '<div class="share-price">E</div>', '<div class="text menu-planning">F</div>']
    gone = ['<div class="share-buttons">G</div>', '<section id="comments"><p>H</p></section>', '<div class="text related-posts">I</div>', '<div class="cookie-notice">J</div>', '<p class="advert">K</p>', '<div id="ad-1">L</div>']
    page = "<body><article>" + "".join(f"{x}{y}" for x, y in zip(kept, gone, strict=True)) + '</article><div class="share-price">M</div></body>'
    assert [t for s, t in html_text.blocks(page) if s == html_text.MAIN] == list("ABCDEF")


@pytest.mark.parametrize("html, kept", [
    ('<article><h2 class="section-header">Title</h2><p>a</p></article>', ["Title", "a"]),
    ('<article><div class="section-header"><h2>Title</h2></div><p>a</p></article>', ["Title", "a"]),
    ('<article><div class="entry-content share-enabled"><p>a</p></div></article>', ["a"]),
    ('<main><p class="notice-period">a</p></main>', ["a"]),
    ('<div class="layout with-sidebar"><p>main text</p><div class="left-sidebar">s</div></div>', ["main text"]),
    ('<article><p>a</p></article><section id="comments"><article class="comment"><p>c</p></article></section>', ["a"]),
    ('<article><p>a</p><div class="post-comments"><article><p>c</p></article></div></article>', ["a"]),
    ('<article><p>a</p></article><div class="related"><article><p>teaser</p></article></div>', ["a"]),
    ('<div class="site-header"><article><p>a</p></article></div>', ["a"]),
    ('<p>text</p><article class="comment"><p>c</p></article>', ["text"]),
    ('<article class="post category-social tag-ads"><p>a</p></article>', ["a"]),
    ('<article><header><h1>T</h1><p>by me</p></header><p>a</p></article>', ["T", "a"]),
    ('<article><p>a</p><div id="disqus_thread"><p>c</p></div></article>', ["a"]),
    ('<article><p>a</p><ul class="comments-thread"><li>c</li></ul></article>', ["a"]),
    ('<article><p>a</p><section class="user-comments-v2"><p>c</p></section></article>', ["a"]),
    ('<article><p>a</p><div class="cookie-notice-text">c</div></article>', ["a"]),
    ('<article><p>a</p><div class="wp-block-subscribe">c</div></article>', ["a"]),
    ('<article><p>a</p><div class="newsletter-signup-v2">c</div></article>', ["a"]),
    ('<article><div class="cookie-recipe"><p>a</p></div><div class="newsletter-body"><p>b</p></div><p class="code-comments">c</p></article>', ["a", "b", "c"]),
    ('<div><p>The whole long main text.</p></div><article><p>teaser</p></article>', ["The whole long main text.", "teaser"]),
    ('<div><p>aside</p></div><article><p>The article itself.</p></article>', ["The article itself."]),
])
def test_names_beside_the_text(html, kept):
    assert [t for s, t in html_text.blocks(f"<body>{html}</body>") if s != html_text.DROPPED] == kept


@pytest.mark.parametrize("unit", ["<a ", '<a href="', "<p class='x\" ", '<x y="1" ', "<a<a", "<!", "<!--", "</", "<a '>\"", "<"])
def test_open_tags_take_linear_time(unit):
    import time

    told = []
    for size in (150_000, 600_000):
        for tail in ("", ">", " \"'>"):
            page = unit * (size // len(unit)) + tail
            began = time.perf_counter()
            html_text.blocks(page)
            told.append(time.perf_counter() - began)
    # a page four times as long takes about four times as long; quadratic time would be minutes
    assert sum(told) < 10


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<a ", "<p>", "</p>", '"', "'", ">", "<", "x", "=", "<!--", "-->", "<!d", "</", " ", "/"]), max_size=14).map("".join))
def test_tags_as_a_backtracking_pattern_finds_them(page):
    pattern = re.compile(r"<(?:!--.*?(?:-->|\Z)|(/)?([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|[!?/][^>]*>)", re.S)
    tags, at, got = html_text._Tags(page), 0, []
    while tag := tags.next(at):
        got.append(tag)
        at = tag[1]
    assert got == [(m.start(), m.end(), bool(m[2] and m[1]) or page.startswith("</", m.start()) and not m[2], m[2] or "", m[3] or "") for m in pattern.finditer(page)]


def test_deep_and_long_pages(spark):
    import time

    began = time.perf_counter()
    deep = "<div>" * 20_000 + "<p>inside</p>" + "</p></div>" * 20_000 + "x</span>" * 20_000
    assert ("inside" in dict((t, s) for s, t in html_text.blocks(deep))) and time.perf_counter() - began < 5
    long = "<body><article>" + "".join(f"<p>paragraph {i} of a very long page</p>" for i in range(60_000)) + "</article></body>"
    frame = pages(spark, [(1, "http://h/1", long), (2, "http://h/2", deep)]).select("*", *(F.lit(1).alias(n) for n in ("id", "host", "part", "whole", "blocks", "text", "n_chars", "run", "slices")))
    got = {r["page_id"]: r for r in html_text.extract(frame).collect()}
    assert got[1]["text"].count("\n\n") == 59_999 and got[1]["n_chars"] == len(got[1]["text"]) and got[2]["text"].startswith("inside")


def test_repeated_blocks_go_where_no_article_tells(spark):
    common = "this line stands on every single page of the host and is boilerplate"
    rows = [(i, f"http://h.example/{i}", f"<body><div>{common}</div><div>own words of page {i} " + " ".join(f"w{i}x{j}" for j in range(20)) + "</div></body>") for i in range(6)]
    rows += [(9, "http://other.example/9", f"<div>{common}</div>"), (10, "http://h.example/10", f"<article><p>{common}</p></article>")]
    got = {r["page_id"]: r["text"] for r in html_text.extract(pages(spark, rows)).collect()}
    assert all(common not in got[i] and f"own words of page {i}" in got[i] for i in range(6))
    assert got[9] == common and got[10] == common, "another host's page, and an article's own text, stay"


def test_large_hosts_are_judged_whole(spark, monkeypatch):
    rnd = random.Random(17)
    sections = [" ".join(f"s{k}n{j}" for j in range(12)) for k in range(25)]
    rows = []
    for i in range(120):
        blocks = [" ".join(f"w{i}x{j}" for j in range(20)), *rnd.sample(sections, 1), "short on all"]
        if i < 2:
            blocks.append("only two pages of the host have this line so that it stays in")
        rnd.shuffle(blocks)
        page = "".join(f"<div>{b}</div>" for b in blocks)
        rows.append((i, f"http://h.example/{i}", f"<body><article><p>main {i}</p></article>{page}</body>" if i % 5 == 4 else f"<body>{page}</body>"))
    rows += [(200, "http://other.example/", f"<div>{sections[0]}</div>"), (200, "http://other.example/", f"<div>{sections[0]}</div>"), (201, "http://h.example/", None), (202, None, "<p>alone")]
    found = lambda: sorted((r["page_id"], r["text"], r["n_chars"]) for r in html_text.extract(pages(spark, rows)).collect())
    expected = found()
    monkeypatch.setattr(html_text, "SLICE_CHARS", 1500)
    got = found()
    assert got == expected and len(got) == len(rows)
    on = {s: sum(s in h for _, u, h in rows if u and "//h." in u and h) for s in sections}
    assert all(not any(on[s] >= 3 and s in t for s in sections) for i, t, _ in got if i < 120) and sum("only two pages" in t for _, t, _ in got) == 2


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=12), min_size=1, max_size=6))
def test_repeated_runs_equal_brute_force(streams):
    tokens = np.array([t for s in streams for t in s], np.int64)
    page = np.array([i for i, s in enumerate(streams) for _ in s], np.int64)
    on = {}
    for i, s in enumerate(streams):
        for k in range(len(s) - 2):
            on.setdefault(tuple(s[k : k + 3]), set()).add(i)
    expected = []
    for s in streams:
        covered = [False] * len(s)
        for k in range(len(s) - 2):
            if len(on[tuple(s[k : k + 3])]) >= 2:
                covered[k : k + 3] = [True] * 3
        expected += covered
    assert html_text.repeated_runs(tokens, page, 3, 2).tolist() == expected


def test_pages_query(spark):
    import html as entities

    got = {r["page_id"]: r["text"] for r in entry.op5_html(spark, SMALL).collect()}
    for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect():
        inside = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        parts = [" ".join(entities.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)\b[^>]*>", inside)]
        assert got[r["page_id"]] == "\n\n".join(x for x in parts if x)


# -- packing ---------------------------------------------------------------------------
def check_packing(rows, texts, capacity, tokenizer):
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
    import zlib

    for doc, text in texts.items():
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        own, at = sorted(by_doc[doc], key=lambda r: r["piece"]), 0
        assert [r["piece"] for r in own] == list(range(-(-len(ids) // capacity))) and all(r["length"] == capacity for r in own[1:])
        for r in own:
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    return len(places)


def test_packing(spark, tokenizer):
    for docs, capacity in ((clashing(spark, ODD), 64), (spark.read.parquet(f"{SMALL}/documents.parquet"), 1024)):
        rows = packing.pack_documents(docs, PATH, capacity).collect()
        used = check_packing(rows, {r["doc_id"]: r["text"] for r in docs.collect()}, capacity, tokenizer)
        assert used <= 1 + 1.02 * sum(r["length"] for r in rows) / capacity
    assert packing.pack_documents(table(spark, []), PATH).count() == 0


def test_ranks_across_shards(spark, monkeypatch, tokenizer):
    monkeypatch.setattr(packing, "SHARD_ROWS", 3)
    texts = ["same text here"] * 20 + ODD
    rows = packing.pack_documents(table(spark, texts), PATH, 32).collect()
    check_packing(rows, dict(enumerate(texts)), 32, tokenizer)


def test_long_runs_of_one_kind(spark, tokenizer):
    """White space alone, digits, marks and letters, each of them longer than a backtracking pattern stands."""
    texts = [" " * 1_200_000 + "x", "\n" * 1_200_000 + "x", "\u3000 " * 300_000, "\t\x1c" * 300 + "\x85" * 500, "7" * 5000, "=-" * 3000, " " * 399 + "a" + "\n" * 401 + "b"]
    check_packing(packing.pack_documents(table(spark, texts), PATH, 512).collect(), dict(enumerate(texts)), 512, tokenizer)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=9))
def test_reduction_loses_no_optimum(lengths):
    """The plan is never worse than best fit decreasing, and the fixed sets leave an optimal packing."""

    def optimum(items, free=()):
        if not items:
            return len(free)
        best, first, seen = 99, items[0], set()
        for i, room in enumerate(free):
            if room >= first and room not in seen:
                seen.add(room)
                best = min(best, optimum(items[1:], free[:i] + (room - first,) + free[i + 1 :]))
        return min(best, optimum(items[1:], (*free, 12 - first)))

    counts = {x: lengths.count(x) for x in lengths}
    plan, left = packing.Plan(12), dict(counts)
    plan.reduce(left)
    rest = sorted((x for x, n in left.items() for _ in range(n)), reverse=True)
    assert sum(n for n, _ in plan.groups) + optimum(tuple(rest)) == optimum(tuple(sorted(lengths, reverse=True)))


# -- language --------------------------------------------------------------------------
def test_language_on_held_out_rows(spark):
    labels = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = [r for r in entry.op10_langid(spark, SF).collect() if r["held_out"]]
    assert len(held) > 100 and all(0 <= r["score"] <= 1 for r in held)
    assert sum(r["lang_pred"] == labels[r["doc_id"]] for r in held) / len(held) >= 0.99


@pytest.fixture(scope="module")
def model(spark):
    return entry.trained(spark.read.parquet(f"{SF}/documents.parquet"))


def test_mixed_text_has_spans(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    pure = {r["lang"]: r["text"] for r in docs.where("n_chars > 400 and n_chars < 900").collect()}
    german, spanish = (" ".join(re.findall(r"[^\W\d_]+", pure[k])[:60]) for k in ("de", "es"))
    spans = langid.label_spans(table(spark, [german + " " + spanish]), model).first()["spans"]
    assert [s["lang"] for s in spans] == ["de", "es"] and abs(spans[1]["start"] - len(german)) < 40


def test_language_edges(spark, model):
    docs = clashing(spark, ODD)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(docs, model).collect()}
    assert got[0] == got[1] == got[2] == ("und", 0.0) and got[10] == got[11]
    assert {r["doc_id"] for r in langid.keep_identified(docs, model).collect()} == {i for i, t in enumerate(ODD) if t and any(unicodedata.category(c)[0] == "L" for c in t)}
    unlabelled = langid.fit(table(spark, ["text"], None), F.lit(True))
    assert langid.identify(docs, unlabelled).where("lang_pred != 'und'").count() == 0
    assert langid.identify(table(spark, []), model).count() == 0


def test_numerals_are_no_letters(spark, model):
    texts = ["½ ² Ⅷ", "① ٣ ㊀", "Ⅷ the house and the dog are in the garden", "中文"]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(table(spark, texts), model).collect()}
    assert got[0] == got[1] == ("und", 0.0) and got[2][0] == "en" and got[3][0] != "und"
    assert {r["doc_id"] for r in langid.keep_identified(table(spark, texts), model).collect()} == {2, 3}


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(), st.sampled_from("aé½²Ⅷ①٣中_ 9ªºǅ\u0301𝟘𐅀")), max_size=30))
def test_words_are_runs_of_letters(text):
    expected, run = [], ""
    for c in text + " ":
        if unicodedata.category(c)[0] == "L":
            run += c
        elif run:
            expected, run = [*expected, run], ""
    assert langid._words(text) == expected


def test_fit_samples_by_label(spark, monkeypatch):
    """A rare label is learned beside a frequent one; held-out rows teach nothing; too many labels are an error."""
    rows = [(i, f"the dog is in the house number {i % 7}", "en", "s", 0) for i in range(400)] + [(1000 + i, "zxq kvv wqz jjx qqk", "xx", "s", 0) for i in range(5)] + [(2000 + i, "ouais le chat dort ici", "fr", "s", 0) for i in range(5)]
    docs = spark.createDataFrame(rows, DOCS)
    fitted = langid.fit(docs, F.col("lang") != "fr", sample=20)
    assert fitted.langs == ["en", "xx"] and 0 < fitted.counts[:, 0].sum() < 400 * 30 / 4 and fitted.counts[:, 1].sum() > 0
    again = langid.fit(docs.withColumn("text", F.when(F.col("lang") == "fr", "other").otherwise(F.col("text"))), F.col("lang") != "fr", sample=20)
    assert again.langs == fitted.langs and (again.counts == fitted.counts).all()
    monkeypatch.setattr(langid, "LANGUAGES", 2)
    with pytest.raises(ValueError):
        langid.fit(docs, F.lit(True))


def test_ties_and_long_texts(spark):
    """A word that two languages share alike goes to the one that sorts first; a text of many words is one path."""
    docs = spark.createDataFrame([(1, "same words", "b", "s", 0), (2, "same words", "a", "s", 0)], DOCS)
    model = langid.fit(docs, F.lit(True))
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(table(spark, ["same", "words same " * 200_000]), model).collect()}
    assert got == {0: "a", 1: "a"}


def test_scripts_narrow_candidates():
    words = ["мир", "und", "ou"]
    counts = np.ones((langid.FEATURES, 2), np.float32)
    scripts = np.zeros((len(langid._NAMES), 2))
    scripts[langid._NAMES.index("Cyrillic"), 0] = scripts[langid._NAMES.index("Latin"), 1] = 10
    scores = langid.Model(["ru", "de"], counts, scripts).scores(words)
    assert scores.argmax(1).tolist() == [0, 1, 1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 4), max_size=7), min_size=1, max_size=4), st.integers(0, 10_000))
def test_paths_are_best(docs, seed):
    scores = np.random.default_rng(seed).normal(size=(5, 3)) * 3
    path = langid.best_paths(np.array([len(d) for d in docs]), np.array([w for d in docs for w in d], np.int64), scores, 2.0)
    at = 0
    for d in docs:
        value = lambda labels: sum(scores[w, k] for w, k in zip(d, labels, strict=True)) - 2.0 * sum(a != b for a, b in zip(labels, labels[1:]))  # noqa: B023, E731
        own, at = path[at : at + len(d)].tolist(), at + len(d)
        import itertools

        assert value(own) >= max(map(value, itertools.product(range(3), repeat=len(d)))) - 1e-9
