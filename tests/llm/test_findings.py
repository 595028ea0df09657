"""Cases of the second round of advice that the given tables do not hold."""

from __future__ import annotations

import hashlib
import random
import re

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from aerolith.llm import html_extraction, pii, quality


def test_numbers_after_a_blank_are_proposed(spark):
    cases = {
        "call 555 123 4567 now": ["555 123 4567"], "Tel: (555) 123-4567": ["(555) 123-4567"], "ssn 123-45-6789": ["123-45-6789"], "Tel:5551234567": ["5551234567"],
        "a 12 34 b 1234567 c": ["1234567"], "- 555.123.4567, +1 555 123 4567.": ["555.123.4567", "+1 555 123 4567"], "12 3456": [],
    }
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id bigint, text string")
    rows = df.select("doc_id", F.transform(pii.proposed(F.col("text")), pii._trimmed)["text"].alias("found")).collect()
    assert {r.doc_id: r.found for r in rows} == dict(enumerate(cases.values()))


def test_named_numbers_beyond_the_base_forms_are_added(spark):
    """Forms the base rules do not know, planted among base spans, and other numbers of like form that must stay."""
    kinds = [
        ("please call {} now", "555 {:03d} 4567", True), ("Tel: {} or", "(555) {:03d}-4567", True), ("ssn {}.", "{:03d}-45-6789", True), ("mail {} or", "root{}@localhost", True),
        ("reach us at {} now", "+1 (988) 555-2{:03d}", True),
        ("hash ab{}ef,", "1234567{:03d}", False), ("about {} items", "12345{:03d}", False), ("the years {} saw", "1984 1985 {:03d}", False), ("call on {} at", "2024-01-15 {:03d}", False),
    ]
    planted = [(text.format(number.format(k)), number.format(k), wanted) for k in range(60) for text, number, wanted in kinds]
    planted.append(("reach us at 1 (988) 555-2000 now", "1 (988) 555-2000", True))  # like base spans but for the sign
    df = spark.createDataFrame([(k, t) for k, (t, _, _) in enumerate(planted)], "doc_id bigint, text string")
    rows = {r.doc_id: r for r in pii.personal_data(df).collect()}
    found = {k: {planted[k][0][s.start : s.end] for s in r.spans} for k, r in rows.items()}
    assert found == {k: ({n} if wanted else set()) for k, (_, n, wanted) in enumerate(planted)}
    assert sum(len(r.base) for r in rows.values()) == 60


@pytest.mark.parametrize("attrs", ['style="overflow:hidden"', 'data-hidden="false"', "title='hidden gems'", 'data-class="nav"', "x=hidden", "class='post' title='a > b'"])
def test_only_names_of_attributes_hide(attrs):
    assert html_extraction.main_text(f"<body><div {attrs}><p>One, two, three.</p></div></body>", []) == "One, two, three."
    for word in ("hidden", "HIDDEN=''", "aria-hidden=true", "class=nav"):
        assert html_extraction.main_text(f"<body><div {attrs} {word}><p>One.</p></div><p>Two.</p></body>" if "class=" not in attrs else f"<body><div {word}><p>One.</p></div><p>Two.</p></body>", []) == "Two."


@pytest.mark.parametrize("tag", ['<svg width="1" d=\'a>b\'/>', "<svg/>", "<math />", "<svg-icon>", "<svg-icon></svg-icon>", "<title-bar>x</title-bar>", "<style-guide/>", "<svg><path/><text>no</text></svg>", "<svg viewBox='0'>no</svg>", "<title>no</title>"])
def test_only_raw_elements_swallow_what_follows(tag):
    text = html_extraction.main_text(f"<body><div><p>One {tag}</p><p>two.</p></div></body>", [])
    assert text.replace("One x", "One") == "One two."


def test_pages_of_a_minority_template_keep_their_article(spark):
    """Templates below SHARE of their host, beside a small block on a winning path; a winning body holds nothing but its own pages."""
    article = "<p>" + "</p><p>".join(f"Line {k}, of the story, with some words, and more of them." for k in range(8)) + "</p>"
    words = " ".join(re.findall(r"<p>(.*?)</p>", article))
    common = [f"<body><div class='content'>{article}</div><div class='extra'><p>More.</p></div></body>"] * 40
    bare = [f"<body>{article}</body>"] * 8
    rare = [f"<body><div class='content'><p>Small block.</p></div><div class='story'>{article}</div></body>"] * 3
    df = spark.createDataFrame([(k, "http://h.example/x", p) for k, p in enumerate(common + bare + rare)], "page_id bigint, url string, html string")
    assert {r.text for r in html_extraction.extract(df).collect()} == {words}
    winners = html_extraction.winning_paths(df.withColumn("host", html_extraction.host_of(F.col("url")))).collect()
    assert [r.winners for r in winners] == [["", ">div.content"]]
    # the path of the host stays where it holds a good part of the page's best container
    assert html_extraction.main_text("<body><div class='content'><p>One, two, three, four.</p></div><div class='story'><p>Five, six, seven, eight, nine.</p></div></body>", [">div.content"]) == "One, two, three, four."
    assert html_extraction.main_text(common[0], ["", ">div.content"]) == words


def test_stages_keep_rows_of_null_and_repeated_ids(spark, tmp_path):
    words = [f"word{k}" for k in range(200)]
    a, b, c = (" ".join(words[k : k + 60]) for k in (0, 60, 120))
    rows = [(None, a), (None, b), (None, b), (3, c), (5, a), (5, a), (5, c + " end"), (7, a), (8, "mail me at a.b@c.de"), (9, b)]
    df = spark.createDataFrame([(i, t, "en", "x", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)
    spark.createDataFrame([(1, " ".join(words[70:90]))], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    def after(stage, given):
        return sorted(((r.doc_id, r.text) for r in stage(spark, given, str(tmp_path)).collect()), key=repr)

    # (5, c end) is a near copy of (3, c) and goes, the other text of the same id stays; a null id is never a copy
    assert after(corpus_pipeline.one_of_each_group, df) == sorted([(None, a), (None, b), (3, c), (5, a), (8, rows[8][1]), (9, b)], key=repr)
    assert after(corpus_pipeline.without_benchmark, df) == sorted([r for r in rows if r[1] != b], key=repr)
    private = df.unionByName(df.where("doc_id = 8").withColumn("doc_id", F.lit(None).cast("bigint"))).unionByName(df.where("doc_id = 8"))
    planted = [*rows, (None, rows[8][1]), rows[8]]
    assert after(corpus_pipeline.without_personal_data, private) == sorted([(i, t.replace("a.b@c.de", "[EMAIL]")) for i, t in planted], key=repr)


def test_last_stage_decodes_what_it_encodes(spark):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    df = spark.createDataFrame([(1, "One, two  three é 😀"), (2, ""), (None, None)], "doc_id bigint, text string")
    for r in corpus_pipeline.tokens(spark, df, "").collect():
        text = {1: "One, two  three é 😀"}.get(r.doc_id, "")
        assert r.ids == library.encode(text, add_special_tokens=False).ids and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(library.decode(r.ids, skip_special_tokens=False).encode()).hexdigest()


STORY = "".join(f"<p>Sentence {k} of the story, long enough to count, and plain.</p>" for k in range(6))
TOLD = " ".join(f"Sentence {k} of the story, long enough to count, and plain." for k in range(6))


@pytest.mark.parametrize(
    "page",
    [
        f"<div class='content-sidebar-wrap'><article>{STORY}</article><div class='sidebar'><p>Side, with, commas</p></div></div>",
        f"<form id='aspnetForm'><div class='page'>{STORY}</div><form class='search'><p>Find</p></form></form>",
        f"<div class='no-comments hentry'>{STORY}</div>",
        f"<div class='has-sidebar'><div>{STORY}</div><div class='sidebar'><p>Side</p></div></div>",
        f"<div class='single comments-open'><h1></h1><div class='entry'>{STORY}</div><div class='comments'>{STORY.replace('Sentence', 'Remark') * 3}</div></div>",
        f"<div class='header-layout'><main>{STORY}</main><div class='comments'><article><p>I, say, so</p></article></div></div>",
        f"<article>{STORY}</article><div class='related'><article><p>Another, teaser</p></article><article><p>One more</p></article></div>",
        f"<div class='post'>{STORY}</div><ol class='comment-list'><article class='comment-body'>{STORY.replace('Sentence', 'Remark') * 4}</article></ol>",
        f"<div id='menu-page'>{STORY}</div><div class='menu'><ul><li><a href='/'>Home</a></li></ul></div>",
    ],
)
def test_wrappers_are_judged_by_what_they_hold(page):
    assert html_extraction.main_text(f"<html><body>{page}</body></html>", []) == TOLD


def test_every_repeat_is_found(spark):
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(12)}" for _ in range(rng.randrange(3, 400))) for _ in range(40)]
    rows = quality.ledger(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).select("doc_id", "n_repeat_words").collect()
    for r in rows:
        w = texts[r.doc_id].split()
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        assert r.n_repeat_words == len({i + d for i, g in enumerate(grams) if grams.count(g) > 1 for d in range(3)})


def test_keys_are_added_without_a_naming_word(spark):
    """Random letter-digit runs, mostly assigned or quoted, some bare; long words with a number stay."""
    rng = random.Random(8)
    run = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    planted = []
    for k in range(400):
        hexa, base = run("0123456789abcdef", 40), run("ABCDEFGHijklmnop0123456789", 32)
        planted += [(f'and so x = "{hexa}" there', hexa), (f"thing: {base}\nnext", base)]
        planted += [(f"the section-of-{1900 + k}-and-of-other-things is", ""), (f"see Programme{k:03d}Intercontinental of", "")]
    planted.append((f"a bare one {run('0123456789abcdef', 40)} stands", None))
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(planted)], "doc_id bigint, text string")
    got = {r.doc_id: {t[s.start : s.end] for s in r.spans} for r in pii.personal_data(df).collect() for t in [planted[r.doc_id][0]]}
    named = [w in got[k] for k, (_, w) in enumerate(planted) if w]
    assert sum(named) >= 0.95 * len(named)
    assert got[len(planted) - 1]
    assert not any(got[k] for k, (_, w) in enumerate(planted) if w == "")
