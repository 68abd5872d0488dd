"""The training-data operators against brute force, exact round trips and edge rows."""

from __future__ import annotations

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricewell.llm import chat, decontaminate, html_text, jaccard, lm, packing, passages, quality, rollup, toxicity
from pricewell.llm.queries import BYTE_BPE, PIECE_BPE
from pricewell.llm.shared import most_frequent

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BASE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join(f"{BASE[i]}{j}" for i, j in zip(rng.integers(0, 24, n), rng.integers(0, 60, n)))


@pytest.fixture(scope="module")
def docs(spark):
    long = prose(1, 400)
    near = long.split()
    near[200] = "changed"
    shared = prose(2, 70)
    texts = [long, long, " ".join(near), None, "", " \n\t ", "one two", "one two", prose(3, 120) + " " + shared, prose(4, 90) + " " + shared + " " + prose(5, 40), prose(6, 30_000), "Same line\nSame line\n" + prose(7, 80), "ⅠⅡ ünïcode … naïve café " * 20]
    rows = [(i, t, "en", "s", 0 if t is None else len(t), "clash") for i, t in enumerate(texts)] + [(None, "no id", "en", "s", 5, "clash")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, n_words string").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def low(t: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def test_html():
    page = '<html><head><title>T</title></head><body><nav><a>Menu</a></nav><div class="cookie-notice">Accept</div><article><h1>Head &amp; more</h1><p>One<br>two   three<p>Four <b>five</b></p><div class="ad">Buy</div><form>mail</form></article><section id="comments"><p>First!</p></section><footer>F</footer></body></html>'
    assert html_text.main_text(page) == "Head & more\n\nOne two three\n\nFour five"
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<p>") == ""
    plain = "A paragraph of plain words without any article element, long enough to make the sums of its window surge."
    assert html_text.main_text(f"<body><ul><li><a href=1>Home</a></li></ul><div>{plain}</div></body>") == plain


LONG = "A paragraph of plain words that is long enough to make the sums of its window surge, as an article's text does."


@pytest.mark.parametrize(
    ("body", "text"),
    [
        ('<article><p>First.</p><p class="ad">Buy</p><p class="cookie-notice">Cookies<p>Second.</p><a class="promo-link" href=1>Go</a><table><tr><td class="ads">x<td>cell</table></article>', ["First.", "Second.", "cell"]),
        (f"<div><p>{LONG}</p></div><article><h2>Teaser</h2><p>Read on.</p></article><article class='comment'><p>{LONG}</p></article>", [LONG]),
        (f"<div><p>{LONG}</p><div class=ad>x</div><p>Short close.</p><div class=ad>y</div></div>", [LONG, "Short close."]),
        (f"<article><div class='search-results-analysis'><p>{LONG}</p></div></article>", [LONG]),
        (f"<main><article><p>{LONG} {LONG}</p></article><article><p>Teaser.</p></article></main>", [f"{LONG} {LONG}"]),
        (f"<main><article><p>{LONG}</p></article><article><p>{LONG}</p></article><article><p>{LONG}</p></article></main>", [LONG] * 3),
        (f"<article><p>{LONG}</p><article><p>A reader says so.</p></article></article>", [LONG]),
        (f"<ul><li class=ad>Buy<ul><li>a<li>b</ul><li>One</ul><p>{LONG}", ["One", LONG]),
        (f"<div role=main><p>{LONG}</p></div><div><p>Elsewhere.</p></div>", [LONG]),
        ("<div><p>Short page.</p></div>", ["Short page."]),
    ],
)
def test_main_text_of(body, text):
    assert html_text.main_text(f"<html><body>{body}</body></html>").split("\n\n") == text


def test_pages_without_article_marks():
    """The window sums find the same text where pages mark no article."""
    import pyarrow.parquet as pq

    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"]).column(0).to_pylist()
    assert all(html_text.main_text(p) == html_text.main_text(re.sub(r"</?article>", "", p)) != "" for p in pages)


def test_extract_rows(spark):
    rows = [(1, "u", None), (1, "u", None), (None, None, "<article><p>x</p></article>")]
    out = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in out) == [(0, "x", 1), (1, "", 0), (1, "", 0)]
    clash = spark.createDataFrame([(1, "u", f"<article>{f'<p>{LONG}' * 20_000}</article>", "clash", 5)], "page_id long, url string, html string, text string, n_chars int")
    assert [(r["text"], r["n_chars"]) for r in html_text.extract(clash).collect()] == [("\n\n".join([LONG] * 20_000), 20_000 * (len(LONG) + 2) - 2)]
    assert html_text.extract(clash.where("false")).count() == 0


def test_packing_round_trip(docs, empty):
    import tiktoken  # noqa: F401

    from pricewell.llm.tokens import byte_bpe

    encoding = byte_bpe(BYTE_BPE)
    out = packing.pack(docs.where("doc_id is not null"), BYTE_BPE).collect()
    parts = collections.defaultdict(list)
    for r in out:
        parts[r["doc_id"]].append((r["start"], np.frombuffer(r["ids"], "<u4").tolist()))
    for r in docs.where("doc_id is not null").collect():
        ids = [i for _, part in sorted(parts[r["doc_id"]]) for i in part]
        assert ids == [*encoding.encode_ordinary(r["text"] or ""), 1]
    fills = {r["sequence_id"]: r["sequence_tokens"] for r in out}
    assert all(f == 2048 or f & (f - 1) == 0 for f in fills.values())
    assert packing.pack(empty, BYTE_BPE).count() == 0


def test_quality_base(docs, empty):
    out = {r["doc_id"]: r for r in quality.quality(docs, PIECE_BPE).collect()}
    for r in docs.collect():
        t, q = r["text"] or "", out[r["doc_id"]]
        w = WORD.findall(t)
        grams = collections.Counter(zip(w, w[1:], w[2:]))
        covered = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert (q["n_words"], q["word_chars"], q["n_symbols"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)))
        assert (q["n_repeat_words"], q["n_dup_lines"]) == (len(covered), len(lines) - len(set(lines)))
        assert q["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert not (q["base_failed"] and q["kept"])
    assert quality.quality(empty, PIECE_BPE).count() == 0


def test_quality_keeps_clean(spark):
    sf = "/root/testdata/sf0.01"
    out = quality.quality(spark.read.parquet(f"{sf}/documents.parquet"), PIECE_BPE).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("not base_failed")
    kept = {r["quality"]: (r["n"], r["k"]) for r in out.groupBy("quality").agg(F.count("*").alias("n"), F.sum(F.col("kept").cast("int")).alias("k")).collect()}
    assert kept[1][0] == kept[1][1] and kept[0][1] < 0.1 * kept[0][0]


def test_quality_bands_by_language(spark):
    shout = " ".join(f"{w}%%% &&&" for w in prose(11, 80).split())
    rows = [(1, shout, "xx"), (2, shout, None), (3, shout, "own"), (4, " ".join(f"слово{i} и дело" for i in range(40)), "own")]
    bands = {s: quality.Band(0.0, 99.0, 1.0, -9.0) for s in quality.SCRIPTS}
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {r["doc_id"]: r for r in quality.quality(docs, PIECE_BPE, bands, {"own": quality.Band(0.0, 99.0, 1.0, -9.0, 0.5)}).collect()}
    assert not any(r["base_failed"] for r in out.values())
    assert [out[i]["kept"] for i in (1, 2, 3, 4)] == [True, True, False, True]
    no_lang = quality.quality(docs.drop("lang"), PIECE_BPE, bands).collect()
    assert all(r["kept"] for r in no_lang)


def test_jaccard_brute_force(spark, docs, empty):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").unionByName(docs.where("doc_id is not null").select(F.col("doc_id") + 10_000, "text").toDF("doc_id", "text"))
    sets = {}
    for r in table.collect():
        w = WORD.findall(low(r["text"] or ""))
        sets[r["doc_id"]] = {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) > 3 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                root[max(find(a), find(b))] = min(find(a), find(b))
    out = jaccard.join(table, 4, 85).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == {i: (len(s), find(i)) for i, s in sets.items()}
    assert jaccard.join(empty, 4, 85).count() == 0


def test_combinations_meet():
    rule, rng = jaccard.Rule(4, 85), np.random.default_rng(0)
    for n in (7, 12, 40, 150, 700):
        for _ in range(20):
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            drop = rule.difference(2 * len(a)) // 2
            b = np.unique(np.concatenate([a[drop:], rng.integers(0, 1 << 63, drop).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            if 100 * both >= 85 * (len(a) + len(b) - both):
                assert set(np.concatenate(list(jaccard.combinations(a, rule)))) & set(np.concatenate(list(jaccard.combinations(b, rule)))) or not rule.difference(2 * n)
            assert jaccard.distance(jaccard.bitmap(a), jaccard.bitmap(b)) <= len(a) + len(b) - 2 * both


def test_chat_round_trip(spark):
    turns = [(1, 1, "assistant", "a <| b \\ <|im_end|>\n"), (1, 0, "user", None), (2, 0, None, "<<|\\n"), (2, 0, None, "<<|\\n"), (2, 1, "assistant", "")]
    df = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").withColumn("extra", F.lit(1))
    out = {r["conv_id"]: r for r in chat.digests(chat.segments(chat.canonical_turns(df))).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert out[1]["turns_sha256"] == sha("user\n\nassistant\na <| b \\ <|im_end|>\n\n") and out[1]["loss_sha256"] == sha("a <| b \\ <|im_end|>\n")
    assert out[2]["n_turns"] == 3 and out[2]["turns_sha256"] == sha("\n<<|\\n\n" * 2 + "assistant\n\n")
    assert chat.digests(chat.segments(chat.canonical_turns(df.where("false")))).count() == 0
    records = spark.createDataFrame([(1, '{"messages":[{"role":"user","content":"q"},{"role":"assistant","content":"a"}]}'), (2, '{"prompt":"p","response":"r"}'), (3, '{"instruction":"i","input":"x","output":"o"}'), (4, '{"conversations":[{"from":"human","value":"h"},{"from":"gpt","value":"g"}]}'), (5, "no json")], "conv_id long, j string")
    rows = sorted((r["conv_id"], r["turn"], r["role"], r["text"]) for r in chat.canonical_json(records, "j").collect())
    assert rows == [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (2, 0, "user", "p"), (2, 1, "assistant", "r"), (3, 0, "user", "i\nx"), (3, 1, "assistant", "o"), (4, 0, "user", "h"), (4, 1, "assistant", "g")]


def test_json_layouts_by_fingerprint(spark):
    texts = {
        1: '{"prompt":"p","response":"r","system":""}',
        2: '{"messages":[{"role":"user","content":"q"}],"prompt":"p","response":"r"}',
        3: '{"query":"q","reply":"r"}',
        4: '{"turn":7,"role":"human","text":"as it is"}',
        5: '{"messages":[],"id":1}',
        6: '{"messages":[{"content":"only"},{"role":"bot","content":null,"x":1}]}',
        7: "[1]",
        8: None,
        9: '{"question":"q","answer":"a","source":{"prompt":"not a field of the record"}}',
    }
    records = spark.createDataFrame(list(texts.items()), "conv_id long, j string").withColumn("v", F.lit("clash"))
    layouts = {r["conv_id"]: (r["fingerprint"] is not None, r["known"]) for r in chat.json_layouts(records, "j").collect()}
    assert [i for i, x in layouts.items() if x == (True, False)] == [2, 3, 5] and [i for i, x in layouts.items() if not x[0]] == [7, 8]
    rows = sorted(map(tuple, chat.canonical_json(records, "j", unknown="skip").collect()))
    assert rows == [(1, 1, "user", "p"), (1, 2, "assistant", "r"), (4, 7, "human", "as it is"), (6, 0, "", "only"), (6, 1, "assistant", ""), (9, 0, "user", "q"), (9, 1, "assistant", "a")]
    with pytest.raises(Exception, match="no mapping"):
        chat.canonical_json(records, "j").collect()
    assert chat.canonical_json(records.where("false"), "j").count() == 0


def test_flat_roles_stay(spark):
    df = spark.createDataFrame([(1, 0, "human", "x")], "conv_id long, turn int, role string, text string")
    assert chat.canonical_turns(df).collect()[0]["role"] == "human"


def test_rollup_idempotent(spark, docs, tmp_path):
    folder, counted = f"file://{tmp_path}/r", rollup.counts(docs, BYTE_BPE)
    rollup.commit(folder, 1, rollup.signed(counted, "v", F.lit(1), F.col("n_tokens")))
    after = counted.where("doc_id != 0").withColumn("n_tokens", F.col("n_tokens") + 1)
    for _ in range(2):
        rollup.commit(folder, 2, rollup.changes(counted.where("doc_id is not null"), after, "v"))
    [row] = rollup.totals(spark, folder).collect()
    expected = after.agg(F.count("*"), F.sum("n_tokens")).first()
    nameless = counted.where("doc_id is null").agg(F.sum("n_tokens")).first()[0]
    assert (row["n_docs"], row["n_tokens"]) == (expected[0] + 1, expected[1] + nameless)


def test_lm_base(docs, empty):
    training = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 1
    rows = {r["doc_id"]: [*WORD.findall(low(r["text"] or "")), None] for r in docs.collect()}
    counts = collections.Counter(w for i, t in rows.items() if i is not None and zlib.crc32(str(i).encode()) % 5 != 1 for w in t)
    n, v = sum(counts.values()), len(counts)
    for r in lm.score(docs, training).collect():
        t = rows[r["doc_id"]]
        assert math.isclose(r["base_score"], sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), rel_tol=1e-9)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t), sum(counts[w] > 0 for w in t), n)
        assert r["score"] < 0
    assert lm.score(empty, training).count() == 0


def test_lm_tail_equals_head(docs, monkeypatch):
    training = F.lit(True)
    whole = {r["doc_id"]: (r["n_known"], round(r["base_score"], 6)) for r in lm.score(docs, training).collect()}
    monkeypatch.setattr(lm, "HEAD", 20)
    assert {r["doc_id"]: (r["n_known"], round(r["base_score"], 6)) for r in lm.score(docs, training).collect()} == whole


@pytest.mark.parametrize(("bits", "per_entry"), [(0, 10), (1 << 22, 20_000)])
def test_lm_scores_do_not_depend_on_the_bound(docs, monkeypatch, bits, per_entry):
    """N-grams that the filter has no room for keep their counts."""
    training = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 1
    scores = lambda: sorted((r["doc_id"] or -1, round(r["score"], 6)) for r in lm.score(docs, training).collect())
    whole = scores()
    monkeypatch.setattr(lm, "MOST_BITS", bits)
    monkeypatch.setattr(lm, "BITS_PER_ENTRY", per_entry)
    assert scores() == whole


def test_decontamination(spark, docs, empty):
    bench = spark.createDataFrame([(1, "Tom has 12 apples and gives 5 apples to Anna so how many apples remain with him after 3 days of this"), (2, None), (3, "short item")], "item_id long, text string")
    rows = [(1, "Before. Tom has 47 apples and gives 9 apples to Maria so how many apples remain with him after 8 weeks of this. After"), (2, "unrelated words only"), (3, None)]
    found = decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    assert [(r["doc_id"], r["item_id"], r["coverage"]) for r in found] == [(1, 1, 1.0)] and found[0]["n_changed"] > 0
    assert decontaminate.contaminated(empty, bench).count() == 0 and decontaminate.contaminated(docs, bench.where("false")).count() == 0


def test_items_that_begin_with_names(spark):
    text = "{0} buys 12 apples at the market. {0} gives 5 of them to her brother. {0} sells 4 more on the way. How many apples does {0} have left?"
    bench = spark.createDataFrame([(1, text.format("Maria")), (2, "Anna walks and Tom walks and Anna sings and Tom sings")], "item_id long, text string")
    rows = [(1, "Well: " + text.format("Olga").replace("12", "31")), (2, text.format("Maria")), (3, text.format("Maria").upper()), (4, "Maria buys nothing at the market today, and her brother has many apples left."), (5, "Eva walks and Jim walks and Lea sings and Sue sings")]
    found = decontaminate.contaminated(spark.createDataFrame(rows * 2, "doc_id long, text string").withColumn("words", F.lit("clash")), bench).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in found) == [(1, 1), (2, 1)]


def test_items_without_windows_are_found_verbatim(spark):
    items = [(1, "Name the red planet."), (2, "Find the next: 2, 4, 8, 16, 32, 64, 128, 256?"), (3, "Why so?"), (4, "1 2 1 2 1 2 1 2 1 2 1 2"), (5, "What is seven times eight then, roughly?"), (6, "Name the red planet."), (None, "no id at all here")]
    texts = ["Quiz: name the Red planet!", "name the red dwarf planet", "find the next: 2, 4, 8, 16, 32, 64, 128, 256", "find the next: 3, 6, 12, 24, 48, 96, 192, 384", "1 2 1 2 1 2 1 2 1 2 1", "0 " + "1 2 " * 3000, None, "", "Why so? " * 9, "what is seven times eight then, roughly", "no id at all here"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "name the red planet")], "doc_id long, text string").withColumn("length", F.lit("clash"))
    own = lambda t: [w.rstrip(".,;:!?") for w in (t or "").lower().split()]
    expected = set()
    for item, text in items:
        w = own(text)
        for i, t in enumerate(texts):
            d = own(t)
            if item and len(w) >= decontaminate.LEAST_WORDS and any(d[k : k + len(w)] == w for k in range(len(d))):
                expected.add((i, item))
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contaminated(docs, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == expected and len(found) == len(expected)
    assert all(own(texts[r["doc_id"]])[r["first_word"] : r["last_word"] + 1] == own(dict(items)[r["item_id"]]) for r in found)


def test_passages(docs, empty):
    found = {r["doc_id"]: r for r in passages.passages(docs).collect()}
    assert {1, 2, 9} <= set(found) and not {0, 3, 4, 5, 6, 7, 10, 11} & set(found)
    assert found[1]["n_words"] == 400 and found[2]["n_words"] == 400 and found[9]["source_doc_id"] == 8
    assert abs(found[9]["n_words"] - 70) <= 2 and abs(found[9]["first_word"] - 90) <= 1
    kept = {r["doc_id"]: r["text"] for r in passages.without_passages(docs, passages.passages(docs)).collect()}
    assert 1 not in kept and len(kept[9].split()) == 200 - found[9]["n_words"] and kept[3] is None
    assert passages.passages(empty).count() == 0


def test_chains_are_ordered_and_disjoint():
    rng = np.random.default_rng(5)
    line = [(i * 7, 100 + i * 7, 6) for i in range(20)]
    noise = [(int(x), int(y), 6) for x, y in rng.integers(0, 400, (30, 2)) if not (x < 146 and 0 <= y - x < 200)]
    found = list(passages.chains(sorted(set(line + noise))))
    assert len(set(found[0]) & set(line)) >= 18
    for chain in found:
        assert all(a[0] + a[2] <= b[0] and a[1] + a[2] <= b[1] for a, b in zip(chain, chain[1:]))


def test_equal_runs_are_whole():
    rng = np.random.default_rng(6)
    a = rng.integers(0, 1 << 31, 400).astype(np.uint32)
    b = np.concatenate([a[300:], rng.integers(0, 1 << 31, 50).astype(np.uint32), a[:120]])
    assert passages.equal_runs([(310, 10), (350, 50), (5, 155), (40, 7)], a, b) == [(0, 150, 120), (300, 0, 100)]


def test_passages_with_differing_words_between(spark):
    """Two exact passages of one pair of documents, against all runs of equal words."""
    texts, expected = [], {}
    for k, gap in enumerate([25, 40, 60, 90, 140, 200, 700]):
        a, b = (prose(100 + 2 * k + i, 60) for i in range(2))
        for side in "xy":
            texts.append(f"{a} {' '.join(f'{side}{k}_{j}' for j in range(gap))} {b}".split())
        first, second = texts[-2:]
        same = [i for i in range(len(first)) if first[i] == second[i]]
        starts = [i for i in same if i - 1 not in same]
        expected[2 * k + 1] = {(i, next(n for n in range(1, len(first)) if i + n not in same)) for i in starts}
    table = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    found = collections.defaultdict(set)
    for r in passages.passages(table).collect():
        found[r["doc_id"]].add((r["first_word"], r["n_words"]))
    assert found == expected


def test_passages_whose_seeds_have_other_first_places(spark):
    """Three lines of 18 words stand in documents of their own, before and between the two that share all 54 words."""
    for seed in (200, 210, 220):
        lines = [prose(seed + i, 18) for i in range(3)]
        texts = {i: f"{prose(seed + 1000 + i, 40)} {line} {prose(seed + 2000 + i, 40)}" for i, line in [*enumerate(lines, 1), *enumerate(lines, 20)]}
        texts |= {i: f"{prose(seed + 3000 + i, 33)} {' '.join(lines)} {prose(seed + 4000 + i, 30)}" for i in (8, 30)}
        table = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(2)
        [row] = passages.passages(table).collect()
        assert (row["doc_id"], row["source_doc_id"]) == (30, 8) and abs(row["first_word"] - 33) <= 1 and abs(row["n_words"] - 54) <= 1


def test_matches_across_batches(spark):
    """First and nearest earlier documents of every place, whatever the batches and the ranges of hot seeds, against all pairs."""
    rng = np.random.default_rng(11)
    rows = sorted({(int(h), int(d), int(a)) for h, d, a in zip(rng.integers(0, 6, 300), rng.integers(0, 25, 300), rng.integers(0, 4, 300))})
    expected, own = set(), set()
    for h, d, a in rows:
        earlier = [r for r in rows if r[0] == h and r[1] < d]
        expected |= {(d, a, *r[1:], h % 2 == 1) for r in ([earlier[0], earlier[-1]] if earlier and earlier[-1][1] != earlier[0][1] else earlier[:1])}
        own |= {(d, a, d, r[2], True) for r in [next(r for r in rows if r[:2] == (h, d))] if not earlier and h % 2 and r[2] < a}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        for hot in ([], [1, 2, 5]):
            places = spark.createDataFrame([(h, 1 + d // 4 if h in hot else 0, d, a) for h, d, a in rows], passages.PLACES)
            places = places.unionByName(passages.carried(places))
            assert {tuple(r) for r in passages.matches(places).collect()} == expected
        assert {tuple(r) for r in passages.matches(places, within=True).collect()} == expected | own
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_hot_seeds_change_nothing(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"{prose(40, 70)} {prose(500 + i, 30)}") for i in range(40)], "doc_id long, text string").repartition(3)
    found = lambda: sorted(map(tuple, passages.passages(docs).collect()))
    whole = found()
    assert len(whole) == 39
    monkeypatch.setattr(passages, "LEAST_HOT", 1)
    monkeypatch.setattr(passages, "HOT_PART", 2)
    monkeypatch.setattr(passages, "HOT_RANGES", 5)
    assert len(passages.hot_seeds(docs)[0]) > 5
    assert found() == whole


def test_scattered_and_own_repeats(spark):
    """Six earlier documents hold a slice each; a passage twice in one document; a gap of 900 words."""
    passage = prose(60, 80).split()
    texts = {i: f"{prose(600 + i, 40)} {' '.join(passage[12 * i : 12 * i + 19])} {prose(700 + i, 40)}" for i in range(6)}
    texts |= {i: f"{prose(800 + i, 50)} {' '.join(passage)} {prose(900 + i, 50)}" for i in (20, 21)}
    twice = prose(61, 120)
    texts[30] = f"{twice} {prose(62, 50)} {twice}"
    a, b = prose(63, 60), prose(64, 60)
    texts |= {i: f"{a} {prose(950 + i, 900)} {b}" for i in (40, 41)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = collections.defaultdict(list)
    for r in passages.passages(df, within=True).collect():
        found[r["doc_id"]].append((r["source_doc_id"], r["first_word"], r["n_words"]))
    assert {k: sorted(v) for k, v in found.items()} == {21: [(20, 50, 80)], 30: [(30, 170, 120)], 41: [(40, 0, 60), (40, 960, 60)]}
    assert {r["doc_id"] for r in passages.passages(df).collect()} == {21, 41}


def test_recall_of_equal_runs(spark):
    """Every document that holds 50 words in a row of an earlier one is found, on a whole small table."""
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    seen, expected = set(), set()
    for r in sorted(table.collect(), key=lambda r: r["doc_id"]):
        w = WORD.findall(low(r["text"] or ""))
        grams = {tuple(w[i : i + 50]) for i in range(len(w) - 49)}
        if grams & seen:
            expected.add(r["doc_id"])
        seen |= grams
    assert expected and expected <= {r["doc_id"] for r in passages.passages(table).collect()}


def test_cut_keeps_other_columns(spark):
    docs = spark.createDataFrame([(0, prose(70, 60), "a", 1), (1, prose(70, 60) + " tail", "b", 2), (1, prose(70, 60) + " tail", "b", 2), (None, "x", None, None), (2, None, "c", 3)], "doc_id long, text string, spans string, _of int")
    kept = passages.without_passages(docs, passages.passages(docs))
    assert kept.columns == docs.columns
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, [(0, prose(70, 60), "a", 1), (1, " tail", "b", 2), (1, " tail", "b", 2), (None, "x", None, None), (2, None, "c", 3)]))


def test_gaps_are_compared_whole():
    rng = np.random.default_rng(3)
    for n, m in ((0, 5), (30, 30), (80, 61), (700, 650)):
        a, b = rng.integers(0, 12, n), rng.integers(0, 12, m)
        row = [0] * (m + 1)
        for x in a:
            before, row = row, [0]
            for j, y in enumerate(b):
                row.append(before[j] + 1 if x == y else max(before[j + 1], row[j]))
        assert passages._common(a, b) == row[-1]


def test_toxicity(spark):
    bad = ["idiot", "moron"]
    rows = [(i, f"{prose(i, 60)} {bad[i % 2]} {prose(i + 1000, 20)} {bad[(i + 1) % 2]}" if i % 4 == 0 else prose(i, 80), int(i % 4 == 0)) for i in range(160)]
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))
    assert {" idiot ", " moron "} <= set(model.terms)
    test = [(1, "you 1d10t here " + prose(1, 10)), (2, prose(2, 50)), (3, None), (4, ""), (5, "what a mоrоn " + prose(9, 10))]
    out = {r["doc_id"]: r["score"] for r in toxicity.score(spark.createDataFrame(test, "doc_id long, text string"), model).collect()}
    assert out[1] > 0.5 and out[5] > 0.5 and max(out[2], out[3], out[4]) < 0.5
    assert toxicity.score(spark.createDataFrame([], "doc_id long, text string"), model).count() == 0


def test_ids_equal_the_vocabulary_library():
    """Whole texts with odd white space, the special token spelled out, and texts next to each other."""
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    from pricewell.llm.tokens import ByteBpe

    texts = ["a <|endoftext|> b", "a<|endoftext|>", "<|endof", "text|> x", "  <|endoftext|>\n<|endoftext|> ", None, "", " ", "\n\n a\n  b 12 ٣٤ é é ", "x\u0085y  z", "\x1c\x1d a", "it's WE'LL 'tis a​b\t\tc", "日本語 text 🙂🙂 end\r\n", prose(9, 500)]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found = [ids[bounds[i] : bounds[i + 1]].tolist() for _, ids, bounds in ByteBpe(BYTE_BPE).texts(pa.array(texts)) for i in range(len(bounds) - 1)]
    assert found == [library.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_head_words_are_bounded(spark):
    """The head holds whole levels of counts, the most frequent ones, never more words than asked for."""
    counts = spark.createDataFrame([(2 * i, n) for i, n in enumerate([1000, 900, 50, 50, 50, 1, 1])], "h long, n long")
    assert sorted(r["n"] for r in most_frequent(counts, 4, 7).collect()) == [900, 1000]
    assert most_frequent(counts, 7, 7).count() == 7
    assert [r["n"] for r in most_frequent(counts, 1, 7).collect()] == [1000]
    assert most_frequent(counts.where("false"), 4, 0).count() == 0
