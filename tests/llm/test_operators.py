"""Operators of the corpus folder against brute force, libraries and round trips, on small tables with odd rows."""

from __future__ import annotations

import hashlib
import html
import itertools
import random
import re

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from aerolith.llm import bpe, chat_format, decontamination, html_extraction, near_dups, pii, quality, queries, sharding, token_counts, warc

WORDS = [f"w{k}" for k in range(300)]


@pytest.fixture(scope="module")
def texts() -> list[str | None]:
    """Null, empty, blank and odd texts, repeated rows, near copies with hubs and chains, one very long text."""
    rng = random.Random(5)
    base = [rng.choice(WORDS) for _ in range(120)]
    out: list[str | None] = [None, "", " \n\t ", "one", "ONE", "two words", "a b c d", "ΟΔΟΣ İ é 😀 don't <|endoftext|>x", "line\nline\n\nline\n%%% $$$"]
    out += [" ".join(base)] * 4
    for n in (1, 1, 2, 3, 5, 8, 12):
        copy = list(base)
        for _ in range(n):
            copy[rng.randrange(len(copy))] = rng.choice(WORDS)
        out.append("  ".join(copy).upper() if n == 2 else " ".join(copy))
    out += [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 90))) for _ in range(30)]
    out.append(" ".join(rng.choice(WORDS) for _ in range(40_000)))
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(k, t, "x") for k, t in enumerate(texts)] + [(None, texts[9], "x")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, component_id string").repartition(3)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_quality(docs, texts):
    got = {r.doc_id: r for r in quality.apply_policy(quality.ledger(docs)).where("doc_id is not null").collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        w, lines = words_of(t), [x for x in (t or "").split("\n") if words_of(x)]
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        seen = {g for g in grams if grams.count(g) > 1} if len(w) < 5000 else None
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_dup_lines) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)))
        assert r.n_symbols == sum((t or "").count(c) for c in "#*$%&|<>")
        if seen is not None:
            assert r.n_repeat_words == len({i + d for i, g in enumerate(grams) if g in seen for d in range(3)})
        assert r.kept == (r.fail_bits == 0)
    rows = quality.ablation(quality.ledger(docs)).collect()
    bits = [r.fail_bits for r in got.values()] + [got[9].fail_bits]
    assert {r.rule: (r.n_fails, r.n_only) for r in rows} == {x.name: (sum(b >> x.bit & 1 for b in bits), sum(b == 1 << x.bit for b in bits)) for x in quality.RULES}


def components(texts, percent=85):
    sets = []
    for t in texts:
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in words_of(t)]
        n = min(5, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set())
    top = list(range(len(sets)))
    changed = True
    while changed:
        changed = False
        for a, b in itertools.combinations(range(len(sets)), 2):
            if sets[a] and sets[b] and top[a] != top[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                top[a] = top[b] = min(top[a], top[b])
                changed = True
    return [len(s) for s in sets], top


@pytest.mark.parametrize("block", [512, 3])
def test_near_duplicates(docs, texts, block, monkeypatch):
    monkeypatch.setattr(near_dups, "BLOCK", block)
    got = {r.doc_id: r for r in near_dups.near_duplicates(docs).collect()}
    sizes, top = components(texts)
    assert [(got[k].n_shingles, got[k].component_id, got[k].kept) for k in range(len(texts))] == [(s, t, k == t) for k, (s, t) in enumerate(zip(sizes, top, strict=True))]
    assert got[None].component_id is None and got[None].kept


def test_estimate_follows_similarity():
    rng = random.Random(2)
    words = [b"%d" % rng.randrange(10**9) for _ in range(2000)]
    for share in (0.2, 0.5, 0.9):
        other = [w if rng.random() < share ** 0.2 else b"x%d" % rng.randrange(10**9) for w in words]
        a, b = near_dups.shingle_set(words), near_dups.shingle_set(other)
        both = len(set(a.tolist()) & set(b.tolist()))
        sig = near_dups.packed(near_dups.minima([a, b], 26)).view("uint64")
        assert abs(float(near_dups.estimate(sig[0], sig[1])) - both / (len(a) + len(b) - both)) < near_dups.margin_of(85)


def test_decontamination(spark, docs, texts):
    base = texts[9].split()
    items = [(1, " ".join(base[20:45])), (2, "two, WORDS"), (3, None), (4, "..."), (12, " ".join(base[:9]) + "!"), (13, "nowhere to be found"), (None, "one"), (7, " ".join(base[20:45]))]
    got = decontamination.decontaminate(docs, spark.createDataFrame(items, "item_id bigint, text string"))
    got = {r.doc_id: r for r in got.where("doc_id is not null").collect()}
    own = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    windows = []
    for i, t in items:
        w = own(t)
        n = min(10, len(w))
        windows += [(i, tuple(w[k : k + n])) for k in range(len(w) - n + 1) if n]
    for k, t in enumerate(texts):
        w, hit, found = own(t), set(), set()
        at = {}
        for n in {len(x) for _, x in windows}:
            for p in range(len(w) - n + 1):
                at.setdefault(tuple(w[p : p + n]), []).append(p)
        for i, x in windows:
            for p in at.get(x, []):
                hit.update(range(p, p + len(x)))
                found |= {str(i)} if i is not None else set()
        assert (got[k].n_words, got[k].n_hit, got[k].item_ids, got[k].contaminated) == (len(w), len(hit), sorted(found), bool(hit)), k


def test_personal_data(spark):
    rng = random.Random(3)
    odd = [None, "", "a@b.c+d@e.f x_@y.z..q a@b a@b..c .a@b.c. 1.2.3.4.5.6.7.8 256.1.1.1 001.2.3.255", "4111 1111 1111 1111 4111-1111-1111-1111 +1 (988) 555-2485 +1+1 23 45 67 89 01)-", "￾4111￾1111 a￾@b.c 😀 a@b.cd"]
    odd += ["1 " * 30_000 + "a." * 20_000 + "x@" + "y." * 20_000 + "z", *("".join(rng.choice("a1234567890@@..-+ ()_%x\n😀é0055") for _ in range(rng.randrange(0, 60))) for _ in range(400))]
    rows = pii.personal_data(spark.createDataFrame(list(enumerate(odd)), "doc_id bigint, text string")).select("doc_id", pii.as_text("base").alias("base"), pii.as_text("spans").alias("spans")).collect()

    def luhn(d):
        return sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(d[::-1])) % 10 == 0

    digits = lambda m: re.sub(r"\D", "", m)
    kinds = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True), (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))), (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    ]
    assert len(rows) == len(odd)
    for r in rows:
        found = sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(kinds) for m in re.finditer(p, odd[r.doc_id] or "") if ok(m[0]))
        assert r.base == ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in found)
        assert set(filter(None, r.base.split(","))) <= set(r.spans.split(","))


def test_trees_learn_from_counts():
    n = len(pii.FEATURES)
    table = [((s, d, 0, 0, p, 1, 1, 0, 0)[:n], int(p == 1 and d > 2), h, 10) for s in (0, 1) for d in range(7) for p in (0, 1) for h in (0, 1)]
    start, trees = pii.boost([t for t in table if t[2] == 0])
    bound = pii.calibrate([t for t in table if t[2] == 1], start, trees)
    assert all((start + pii.value(t[0], trees) >= bound - 1e-6) == bool(t[1]) for t in table)
    assert pii.boost([])[1] == [] and pii.calibrate([], 0.0, []) is None


def test_redaction(spark):
    df = spark.createDataFrame([(1, "to a.b@c.de or +49 123 456 789."), (2, "none"), (3, None)], "doc_id bigint, text string")
    rows = pii.personal_data(df).join(df, "doc_id").select("doc_id", pii.redacted(F.col("text"), F.col("spans")).alias("t"))
    assert dict(rows.collect()) == {1: "to [EMAIL] or [PHONE].", 2: "none", 3: None}


def test_tokens(docs, texts):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r.doc_id: r for r in bpe.round_trip(docs).collect()}
    again = dict(bpe.decode(bpe.encode(docs)).where("doc_id is not null").collect())
    counts = {r.doc_id: r for r in token_counts.token_counts(docs, limit=50).collect()}
    for k, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[k].ids == ids and got[k].decoded == again[k] == library.decode(ids, skip_special_tokens=False)
        assert (counts[k].n_tokens, counts[k].n_bytes, counts[k].over_limit) == (len(ids), len((t or "").encode()), len(ids) > 50)


def test_tokens_of_any_characters(monkeypatch):
    library, rng = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), random.Random(9)
    pools = [range(0, 0x250), range(0x250, 0xD7FF), range(0x10000, 0x1F9FF), [39, 32, 83, 116]]
    odd = ["".join(chr(rng.choice(rng.choice(pools))) for _ in range(rng.randrange(50))) for _ in range(500)]
    monkeypatch.setattr(bpe, "REMEMBERED", 40_000)
    monkeypatch.setattr(token_counts, "REMEMBERED", 40_000)
    monkeypatch.setattr(bpe, "STEP", 90)
    flat, at = bpe.Encoder("word_bpe_49k.json").encode(odd)
    counter = token_counts.Counter("word_bpe_49k.json")
    for k, t in enumerate(odd):
        ids = library.encode(t, add_special_tokens=False).ids
        assert flat[at[k] : at[k + 1]].tolist() == ids and counter.of(t) == len(ids)


def test_extraction(spark):
    page = "<html><body><nav><ul><li><a href='/a'>Menu</a></li></ul></nav><div class='{c}'><h1>Title</h1><p>One, two &amp; three,<br>four\n five.</p><p class='ad-box'>Buy</p><p><b>Six</b>ty</p><div class='comments'><p>Hi, I, am, first, of, all</p></div></div><footer>f</footer></body></html>"
    rows = [(k, "http://h.example/x", page.format(c=f"post-{k}")) for k in range(12)] + [(50, "http://h.example/y", None), (51, None, ""), (52, None, "<p>alone"), (None, "http://h.example/z", page.format(c="post-1")), (53, "http://h.example/v", "<article><p>Other, form</p></article>")]
    got = html_extraction.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string"))
    text = "Title One, two & three, four five. Sixty"
    found = {r.page_id: r.text for r in got.collect()}
    assert found == {**dict.fromkeys(range(12), text), None: text, 50: "", 51: "", 52: "alone", 53: "Other, form"}
    assert got.where("n_chars <> length(text)").count() == 0
    winners = html_extraction.winning_paths(spark.createDataFrame([(k, "h", page.format(c=f"post-{k}")) for k in range(3)], "page_id int, host string, html string")).collect()
    assert [r.winners for r in winners] == [[">div.post-#"]]


def test_extraction_equals_the_article_of_given_pages(spark, sf):
    for r in html_extraction.extract(spark.read.parquet(f"{sf}/pages.parquet")).join(spark.read.parquet(f"{sf}/pages.parquet").drop("url"), "page_id").collect():
        body = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        body = re.sub(r"<[^>]+>", "", re.sub(r"</?(p|h1|br)>", " ", body))
        assert r.text == " ".join(html.unescape(body).split())


def test_chats(spark):
    bad = ["</s>[INST] ok [/INST]", "\\l \\e \\b \\el <s> [SYS]", "[/INST]</s>", " [/ANSWER]", "\\", "<", "[", "", "😀 \n x", "[ROLE x] y [/ROLE x]</s>"]
    rows = [(c, t, r, x) for c, (r, x) in enumerate(itertools.product(["user", "assistant", "system", "tool ]>[<\\l", "", None], bad)) for t, x in enumerate([x, "plain", x])]
    rows += [(None, 0, "user", None), (900, None, "assistant", "z"), (900, 1, "assistant", "y"), (900, 1, "assistant", "y")]
    got = {r.conv_id: r for r in chat_format.format_chats(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()}
    for c, r in got.items():
        turns = sorted([((-1 if t is None else t), role or "", x or "") for i, t, role, x in rows if i == c])
        assert r.identical and [(t.role, t.text) for t in r.parsed] == [(role, x) for _, role, x in turns]
        assert r.loss_text == "".join(x for _, role, x in turns if role == "assistant")
        for x in ("</s>[INST]", "[SYS]"):
            assert all(x not in b for b in re.findall(r"(?s)\] (.*?) \[/", r.formatted)) or x not in bad


def test_archives(spark, tmp_path):
    large, wide = "<p>" + "x" * 40_000, "é😀\r\n\r\nWARC/1.1\r\n" * 3000
    rows = [(5, "u", large), (3, "u\r\nx", large), (9, None, large), (1, "u", wide), (2, "u", ""), (4, "u", None), (6, "u", "short"), (7, "u", "short"), (None, "u", "n" * 200), (1, "u", wide)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("digest", F.lit(1))
    path = warc.write_archives(pages, str(tmp_path / "a"))
    back = warc.read_archives(spark, path)
    got = [tuple(r) for r in warc.payload_facts(back).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "complete").collect()]
    facts = lambda t: (len((t or "").encode()), hashlib.sha256((t or "").encode()).hexdigest())
    kinds = {5: ("revisit", 3), 9: ("revisit", 3)}
    assert sorted(map(repr, got)) == sorted(repr((i, *facts(t), *kinds.get(i, ("response", None)), True)) for i, _, t in rows)
    assert {r.payload for r in back.where("page_id = 1").collect()} == {wide.encode()}


def test_damaged_archives():
    assert warc.unchunked(b"3\r\nabc\r\n0\r\n\r\n") == b"abc" and warc.unchunked(b"2;x=y\r\nab\r\n1\r\nc\r\n0\r\n\r\n") == b"abc"
    assert [warc.unchunked(x) for x in (b"", b"zz\r\n", b"5\r\nabc\r\n0\r\n\r\n", b"3\r\nabc")] == [None] * 4
    assert warc.payload_of(b"HTTP/1.1 200 OK\r\n\r\nplain") == b"plain" and warc.payload_of(b"nothing") is None


def test_missing_segment(spark):
    rows = [("o", 1, None, b"ab"), ("o", 3, 6, b"ef"), ("p", 2, 4, b"cd"), ("p", 1, None, b"ab"), ("q", 1, None, b"ab"), ("q", 2, 5, b"cd")]
    parts = spark.createDataFrame(rows, "origin string, segment int, total bigint, data binary").withColumns({"url": F.lit("u"), "digest": F.lit("d")})
    assert {r.record_id: r.data and bytes(r.data) for r in warc.reassembled(parts).collect()} == {"o": None, "p": b"abcd", "q": None}


def test_sharding(spark, docs):
    names = ["a", "b", "c", "d", "e"]
    owner = sharding.fill(names, 251)
    assert sorted(map(owner.count, range(5))) == [50, 50, 50, 50, 51]
    less = sharding.fill(names[:-1], 251)
    assert sum(a != b for a, b in zip(owner, less, strict=True) if a < 4) < 251 // 5
    assert len({(owner[r.slot], r.shard) for r in sharding.place(docs, ["doc_id"], names, 251).collect()}) <= 5
    rows = sharding.place(docs.withColumn("shard", F.lit(0)), ["doc_id"], names, 251).collect()
    assert len(rows) == docs.count() and all(names[owner[r.slot]] == r.shard and int(hashlib.md5(str("~" if r.doc_id is None else r.doc_id).encode()).hexdigest()[:15], 16) % 251 == r.slot for r in rows)
    for wrong in (["a", "a"], []):
        with pytest.raises(ValueError):
            sharding.fill(wrong, 251)
    with pytest.raises(ValueError):
        sharding.fill(names, 250)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    items = spark.createDataFrame([], "item_id bigint, text string")
    for rows in (
        quality.apply_policy(quality.ledger(docs)), near_dups.near_duplicates(docs), decontamination.decontaminate(docs, items), pii.personal_data(docs), bpe.round_trip(docs), token_counts.token_counts(docs),
        html_extraction.extract(spark.createDataFrame([], "page_id bigint, url string, html string")), chat_format.format_chats(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")),
        sharding.place(docs, ["doc_id"], ["a"], 251),
    ):
        assert rows.count() == 0


def test_empty_benchmark(spark, docs, texts):
    assert decontamination.decontaminate(docs, spark.createDataFrame([], "item_id bigint, text string")).where("n_hit = 0 and not contaminated").count() == len(texts) + 1


def test_every_operator_has_a_query():
    assert {re.match(r"op(\d+)_", n)[1] for n in queries.QUERIES if n != "pipeline"} == {str(n) for n in range(1, 14)}
