"""Language ID, PII, HTML extraction, URL filters, fingerprints and the pipeline."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from weftgraph.llm import fingerprints, html_extract, html_training, langid, mixing, pii, shingle_dedup, simhash_dedup, url_filter
from weftgraph.llm.html_dom import parse
from weftgraph.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def frame(spark, rows, more="lang string, source string, n_chars long"):
    df = spark.createDataFrame([(*r, *[None] * (5 - len(r))) for r in rows], f"doc_id long, text string, {more}")
    return df.withColumn("row", F.lit("clash")).withColumn("score", F.lit(7)).withColumn("entities", F.lit(1))


# language ID


def test_held_out_accuracy(spark):
    docs = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    found = QUERIES["op5_language_id"](spark, "/root/testdata/sf0.01").collect()
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in found)
    held = [r for r in found if r.held_out]
    assert len(found) == len(docs) and sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.98 * len(held)


def test_filters_have_no_false_negatives():
    rng = np.random.default_rng(0)
    members = {f"l{k:03d}": rng.integers(0, 2**63, 300).astype(np.uint64) for k in range(70)}  # more than one slice
    filters = langid.Filters.of(members)
    assert filters.masks.shape[1] == 2
    for k, name in enumerate(filters.languages):
        for where in langid.Filters.positions(members[name], len(filters.masks)):
            assert (filters.masks[where, k // 64] >> np.uint64(k % 64) & np.uint64(1)).all()
    assert filters.false_positives.max() < 0.01


def test_edges_of_language_id(spark):
    prose = {"en": "the thing and the other ones were there with them ", "de": "der die das und nicht eine schöne zeit für alle "}
    rows = [(i, prose[lang] * 3, lang) for i, lang in enumerate(["en", "de"] * 10)]
    rows += [(100, None), (101, ""), (102, "123 %%%"), (103, "the other thing"), (None, prose["en"], "en"), (104, prose["de"] * 60_000), (105, "東京"), (100, None)]
    df = frame(spark, rows)
    found = langid.identify(df).collect()
    assert len(found) == len(rows) and set(found[0].row.asDict()) == set(df.columns)
    of = {r.row.doc_id: r for r in found}
    assert [of[k].lang_pred for k in (100, 101, 102)] == ["und"] * 3 and of[100].score == 0
    assert of[103].lang_pred == of[None].lang_pred == "en" and of[104].lang_pred == "de" and of[105].share == 0
    assert langid.identify(df.limit(0)).count() == 0
    assert of[105].lang_pred == "de" and of[105].score == 0  # the language with the most text
    unlabelled = df.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.identify(unlabelled).collect()} == {"und"}
    stays = lambda d: sorted(r.doc_id or 0 for r in corpus_pipeline.language_id(spark, d, "").collect())
    assert stays(unlabelled) == stays(df) == sorted([0, *range(20), 103, 104, 105])
    odd = df.withColumn("text", F.when(F.col("doc_id") == 105, F.repeat(F.lit("東京"), 40)).otherwise(F.col("text")))
    assert 105 not in stays(odd)


# PII


def test_permutation():
    p = pii.Permutation("k")
    for n in (2, 3, 10, 257, 1000):
        values = [p("t", x, n) for x in range(n)]
        assert sorted(values) == list(range(n)) and all(x != y for x, y in enumerate(values))


def test_surrogates():
    s = pii.Surrogates()
    text = (
        'Mail ANNA.B@FIRMA.DE anna.b@firma.de the.24@mail4.example.com +1 (640) 555-0953 10.1.2.3 97.51.17.173 4111 1111 1111 1111 '
        '1142126282388588$$$ token = "2abc3ff2ca8fb1e4c565a0eb63815530a948bdde" DE89 3704 0044 0532 0130 00 123-45-6789'
    )
    new, found = pii.replace(text, s)
    assert [e[0] for e in found] == ["email"] * 3 + ["phone", "ipv4", "ipv4", "card", "card", "secret", "iban", "ssn"]
    for kind, start, end, surrogate, _ in found:
        assert text[start:end] not in new and (kind == "email" or re.sub(r"\w", "", surrogate) == re.sub(r"\w", "", text[start:end]))
    assert found[0][3] == found[1][3].upper() and found[0][4] == found[1][4]
    assert found[4][3].startswith("10.") and not found[5][3].startswith("10.")
    card, iban = re.sub(" ", "", found[6][3]), found[9][3]
    assert pii._luhn(card[:-1]) == int(card[-1]) and pii._mod97(iban[4:], iban[:2]) == int(iban[2:4])
    assert re.fullmatch(r"[\da-f]{40}", found[8][3])
    assert pii.replace(text, pii.Surrogates("other"))[0] != new


def test_names():
    s = pii.Surrogates()
    text = "Frau Schmidt met Anna Schmidt and Peter Huber; Anna left. Ольга Иванова and Иван Иванов."
    new, found = pii.replace(text, s)
    of = {text[a:b]: x for _, a, b, x, _ in found}
    assert of["Anna"] in pii.GIVEN["latin", "f"] and of["Peter"] in pii.GIVEN["latin", "m"] and of["Ольга"] in pii.GIVEN["cyrillic", "f"]
    assert of["Иванова"] == of["Иванов"] + "а" and of["Schmidt"][0].isupper() and new.count(of["Schmidt"]) == 2 and new.count(of["Anna"]) == 2
    assert "Anna" not in new and "Schmidt" not in new


def test_no_two_entities_share_a_surrogate():
    s, r = pii.Surrogates(), random.Random(1)
    for kind, make in {
        "email": lambda: f"{r.choice('abc')}.{r.randint(0, 99):02d}@mail{r.randint(0, 9)}.{r.choice(['example.com', 'firma.de', 'firma.at'])}",
        "phone": lambda: f"+1 ({r.randint(0, 19):03d}) 555-{r.randint(0, 99):04d}",
        "ipv4": lambda: f"{r.choice([10, 9])}.0.{r.randint(0, 9)}.{r.randint(0, 255)}",
        "card": lambda: f"41111111111{r.randint(0, 99999):05d}",
        "family": lambda: "".join(r.choice("aeb") for _ in range(3)).capitalize(),
    }.items():
        own = {make() for _ in range(400)}
        assert len({getattr(s, kind)(x) for x in own}) == len(own) and all(getattr(s, kind)(x) != x for x in own)


def test_pii_over_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("entities", F.lit(1))
    found = pii.pseudonymize(docs)
    rows = found.collect()
    for r in rows:
        old, at, out = r.row.text, 0, []
        for e in r.entities:
            assert old[e.start : e.end] not in (e.surrogate, r.text)
            out += [old[at : e.start], e.surrogate]
            at = e.end
        assert "".join([*out, old[at:]]) == r.text
        assert not set(re.findall(r"\S+@mail\d\S+\.com|\b\d{16}\b|\b[0-9a-f]{40}\b|\+1 \(\d+\) 555-\d+", old)) & set(re.findall(r"\S+", r.text))
    assert sum(len(r.entities) for r in rows) > 50 and pii.collisions(found).count() == 0
    edge = pii.pseudonymize(frame(spark, [(1, None), (2, ""), (None, "a@b.co"), (3, "x" * 300_000 + " 10.0.0.1 " + "@" * 1000)])).collect()
    assert sorted((r.row.doc_id or 0, len(r.entities)) for r in edge) == [(0, 1), (1, 0), (2, 0), (3, 1)] and {r.text for r in edge} > {None, ""}
    assert pii.pseudonymize(docs.limit(0)).count() == 0


# HTML


def brute_marginals(parents, local, kinds, pair):
    n, total, mass = len(parents), 0.0, np.zeros(len(parents))
    for state in range(2**n):
        y = [state >> i & 1 for i in range(n)]
        w = np.exp(sum(local[i] * y[i] for i in range(n)) + sum(pair[kinds[i], y[parents[i]], y[i]] for i in range(n) if parents[i] >= 0))
        total, mass = total + w, mass + w * np.array(y)
    return mass / total


def test_messages_give_exact_marginals():
    rng = np.random.default_rng(0)
    page = "<div><p>a<p>b<ul><li>c<li>d</ul></div><article>e<div>f</div></article>"
    blocks = parse(page)
    forest = html_extract.Forest([blocks, blocks])
    pair, local = rng.normal(size=(2 * len(html_extract._KINDS), 2, 2)), rng.normal(size=2 * len(blocks))
    found = html_extract.marginals(forest, local, pair)[0]
    n = len(blocks)
    expected = brute_marginals([b.parent for b in blocks], local[:n], forest.kinds[:n], pair)
    assert np.allclose(found[:n], expected)


def test_held_out_layouts():
    model, wrong, total = html_extract.default_model(), 0, 0
    for page in html_training.labelled_pages(200, seed=77):
        blocks, labels = parse(page), []
        chances = model.content([blocks])[0]
        for b in blocks:
            labels.append(b.label if b.label is not None else labels[b.parent] if b.parent >= 0 else 0)
        texts = [i for i, b in enumerate(blocks) if b.segments]
        total += len(texts)
        wrong += sum((chances[i] > 0.5) != labels[i] for i in texts)
    assert wrong < 0.01 * total


def test_main_text():
    model = html_extract.default_model()
    page = (
        '<html><head><title>x</title><script>var t="</p>";</script></head><body><nav><ul><li><a href=/a>menu one</a></li><li><a href=/b>two</a></ul></nav>'
        '<div class="ad">Buy this now.</div><article><h1>Title &amp; more</h1><p><b>First  line.<br><p>Second\n line&nbsp;here, &lt;b&gt; and so on. It goes on.</p>'
        '<p>Third a&ampb.</p></article><div class="comments"><p>I like it. Really.</p></div><footer>&copy; me</footer></body></html>'
    )
    assert html_extract.main_texts([page], model) == ["Title & more First line. Second line here, <b> and so on. It goes on. Third a&b."]
    cut = page[: page.index("Third")] + "Third <foot"
    assert html_extract.main_texts([cut], model)[0].endswith("It goes on. Third")
    assert html_extract.main_texts([None, "", "<", "plain  text", "<p", "<!-- x"], model) == ["", "", "<", "plain text", "", ""]


def test_extraction_over_pages(spark):
    import html

    found = QUERIES["op2_html_extraction"](spark, SF).collect()
    raw = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert len(found) == len(raw)
    for r in found:
        inner = re.search(r"<article>(.*?)</article>", raw[r.page_id], re.DOTALL)[1]
        assert r.text == " ".join(html.unescape(re.sub("<[^>]*>", " ", re.sub("</?b>", "", inner))).split()) and r.n_chars == len(r.text)
    df = spark.createDataFrame([(1, None, 1), (1, None, 1), (2, "<div>" * 3000 + "deep.", 1)], "page_id long, html string, text int")
    assert len(html_extract.extract(df).collect()) == 3 and html_extract.extract(df.limit(0)).count() == 0


# URL filters


def plain_verdict(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url[url.index("://") + 3 :]
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[2:] if fits else (None, default)))


@pytest.mark.parametrize("parts", [1, 7])
def test_urls_against_brute_force(spark, parts):
    r = random.Random(parts)
    rules = [*url_filter.RULES, ("a.b.com", "", "block"), ("b.com", "/x", "allow"), ("b.com", "/x", "block"), ("com.b", "/", "block"), ("", "", "block")]
    hosts = ["com", "example.com", "www.example.com", "m.www.example.com", "net", "x.net", "xnet", "a.b.com", "z.a.b.com", "b.com", "COM.B", "é.com", "example.com:80", "", "com."]
    urls = [f"http://{r.choice(hosts)}{r.choice(['', '/', '/en/', '/en', '/es/a', '/fr/?q=/en/', '?x=://b', '#y', '/x/y'])}" for _ in range(400)]
    urls += [None, "", "example.com/en/", "://", "http://"] + ["https://net/es/"] * 500
    df = spark.createDataFrame([(i, u, "c", 1) for i, u in enumerate(urls)], "page_id long, url string, host string, at int").repartition(parts)
    for own in (rules, list(url_filter.RULES)):
        found = url_filter.judge(df, rules=url_filter.rule_table(spark, own)).collect()
        assert len(found) == len(urls)
        for x in found:
            assert (x.host, x.path, x.rule, x.verdict) == plain_verdict(urls[x.page_id], own), urls[x.page_id]
    none = url_filter.judge(df, rules=url_filter.rule_table(spark).limit(0), default="block")
    assert {(x.rule, x.verdict) for x in none.collect()} == {(None, "block")}
    assert url_filter.judge(df.limit(0)).count() == 0


# fingerprints


def check_edits(found, rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    expected = []
    for k, (doc, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        n = len(text) // 3
        new = text[: len(text) - n] + after[:n]
        a, b, c = map(fingerprints.fingerprint, (text, new, after))
        expected.append((doc or 0, len(text), hashlib.sha256(new.encode()).hexdigest(), a.hex(), b.hex(), fingerprints.likeness(a, b), fingerprints.likeness(a, c)))
    assert sorted((r.doc_id or 0, *r[1:7]) for r in found) == sorted(expected)


def test_edits_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check_edits(QUERIES["op10_fingerprints"](spark, SF).collect(), [(r.doc_id, r.text) for r in docs.collect()])
    rows = [(1, None), (2, ""), (3, "a b c d e f g h"), (3, "zwei"), (None, "x y"), (4, "long text " * 50_000), (5, "éç😀é")]
    df = frame(spark, rows).repartition(3)
    check_edits(fingerprints.edits(df).collect(), rows)
    check_edits(fingerprints.edits(df.filter("doc_id = 5")).collect(), [(5, "éç😀é")])
    assert fingerprints.edits(df.limit(0)).count() == 0


def test_likeness_follows_the_text(spark):
    found = QUERIES["op10_fingerprints"](spark, "/root/testdata/sf0.01").collect()
    long = [r for r in found if r.n_chars > 1000]
    assert np.mean([r.near_edited for r in long]) > 0.5 and np.mean([r.near_next for r in long]) < 0.15


def test_block_tables_find_all_within_radius(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2, (40, 128))
    bits = np.concatenate([base] + [base ^ (rng.random(base.shape) < p) for p in (0.01, 0.02, 0.03)]).astype(np.uint8)
    prints = [np.packbits(b).tobytes() for b in bits]
    df = spark.createDataFrame([(i, bytearray(p)) for i, p in enumerate([*prints, *prints[:5]])], "doc_id long, fingerprint binary")
    found = {(bytes(r.fingerprint), bytes(r.neighbour)): r.bits for r in fingerprints.within_radius(df, 4).collect()}
    apart = lambda a, b: (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_count()
    own = set(prints)
    assert found == {(a, b): apart(a, b) for a in own for b in own if a != b and apart(a, b) <= 4} and found


# pipeline


def test_pipeline_stages(spark, tmp_path):
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows += [(1000, None, "en", "src0", None), (1001, "12 34", None, None, 5), (1002, rows[3][1], None, None, None), (1002, rows[3][1], None, None, None), (None, "Mail to the.24@mail4.example.com and the others there", "en", None, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("row", F.lit("clash"))
    kept = docs
    for name, step in corpus_pipeline.STAGES:
        before, kept = kept, step(spark, kept, SF)
        kept.write.parquet(f"{tmp_path}/{name}")
        kept = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert kept.columns == docs.columns
        ids = lambda df: sorted(r.doc_id if r.doc_id is not None else -1 for r in df.select("doc_id").collect())
        if name == "language_id":
            assert ids(kept) == [x for x in ids(before) if x not in (1000, 1001)]
        if name == "simhash_dedup":
            found = shingle_dedup.near_duplicates(before).collect()  # checked against all pairs in test_shingle_dedup
            assert ids(kept) == sorted({r.component if r.component is not None else -1 for r in found})
        if name == "pii":
            assert ids(kept) == ids(before) and not kept.filter("text LIKE '%the.24@mail4.example.com%'").count()
            assert not kept.filter("n_chars <> length(text)").count()
        if name == "mixing":
            copies = {(-1 if r.row.doc_id is None else r.row.doc_id): r.copies for r in mixing.mix(before).collect()}
            assert ids(kept) == sorted(x for x, n in copies.items() for _ in range(n))
    assert kept.agg(F.sum("length")).first()[0] == kept.filter("start = 0").agg(F.sum("doc_tokens")).first()[0]
    empty = docs.limit(0)
    for _, step in corpus_pipeline.STAGES:
        assert step(spark, empty, SF).count() == 0
