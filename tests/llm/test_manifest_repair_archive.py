"""Operators 11 to 13 against plain versions, exact round trips, their SQL and edge rows."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import zlib

import duckdb
import pytest
import zstandard
from pyspark.sql import functions as F

from pricewell.llm import merkle, oracles, queries, repair, warc

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, node string, path int, key string"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(r, text) -> str:
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))


def plain_tree(nodes: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for path, i in zip(paths, at, strict=True):
            run = nodes[i // 16 * 16 : i // 16 * 16 + 16]
            path.append(("".join(run[: i % 16]), "".join(run[i % 16 + 1 :])))
        nodes = [digest("".join(nodes[j : j + 16])) for j in range(0, len(nodes), 16)]
        at = [i // 16 for i in at]
    return nodes[0], paths


def plain_manifest(rows) -> list[tuple]:
    groups: dict = {}
    for r in rows:
        groups.setdefault(r["source"], []).append((r, plain_leaf(r, r["text"])))
    names, out, subs = sorted(groups, key=lambda s: (s is not None, (s or "").encode())), [], []
    for name in names:
        groups[name].sort(key=lambda x: (x[0]["doc_id"] is not None, x[0]["doc_id"] or 0, x[1]))
        subs.append(plain_tree([x[1] for x in groups[name]]))
    root, above = plain_tree([s[0] for s in subs])
    for name, (subroot, paths), up in zip(names, subs, above, strict=True):
        for (r, leaf), path in zip(groups[name], paths, strict=True):
            i, text = r["doc_id"], r["text"]
            if i is not None and text is not None and zlib.crc32(str(i).encode()) % 5 == 0:
                text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
            node = plain_leaf(r, text)
            for before, after in path + up:
                node = digest(before + node + after)
            out.append((i, leaf, subroot, root, digest("".join(a + b for a, b in path + up)), node, node == root))
    return sorted(out, key=repr)


def manifest_of(spark, folder, rows) -> list[tuple]:
    spark.createDataFrame(rows, DOCS).repartition(5).write.parquet(f"{folder}/documents.parquet")
    out = queries.op11_merkle_blocks(spark, str(folder))
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(tuple, out.collect()), key=repr)


def test_manifest_of_edge_rows(spark, tmp_path):
    """Null ids, sources and texts, lone leaves, 16, 17, 256, 257 and 4,100 leaves, equal rows, long texts, clashing names."""
    rows = [(i, f"Text {i}", "en", "big", 7, "x", 1, "k") for i in range(4100)]
    rows += [(10_000 + i, "T" * i, None, f"s{n}", i, None, None, None) for n in (1, 16, 17, 256, 257) for i in range(n)]
    rows += [(None, None, None, None, None, None, None, None)] * 3 + [(5, "Ab" * 200_000, "de", None, 1, "", 0, ""), (7, "Équal", "fr", "é=;", 5, "", 0, "")] + [(7, "Équal", "fr", "é=;", 5, "", 0, "")] * 40
    got = manifest_of(spark, tmp_path, rows)
    assert got == plain_manifest(spark.createDataFrame(rows, DOCS).collect())
    assert 0 < sum(r[6] for r in got) < len(got)


def test_manifest_of_many_groups_and_of_none(spark, tmp_path):
    rows = [(i, "a", "en", f"g{i % 700}", 1, "", 0, "") for i in range(1500)]
    assert manifest_of(spark, tmp_path / "a", rows) == plain_manifest(spark.createDataFrame(rows, DOCS).collect())
    assert manifest_of(spark, tmp_path / "b", []) == []
    assert manifest_of(spark, tmp_path / "c", rows[:1])[0][1:4] == (plain_leaf(spark.createDataFrame(rows[:1], DOCS).first(), "a"),) * 3


def test_manifest_keeps_other_columns(spark):
    n1, n2 = digest("1"), digest("2")
    leaves = spark.createDataFrame([(1, "s", n1, "old", 5), (2, "s", n2, "old", 6)], "doc_id long, source string, node string, root string, pos int")
    out, tables = merkle.manifest(leaves, "source", "doc_id")
    assert sorted((r["doc_id"], r["pos"], r["path"][0]["after"], r["root"] == r["subroot"] == digest(n1 + n2)) for r in out.collect()) == [(1, 5, n2, True), (2, 6, "", True)]
    merkle.released(*tables)


def plain_repair(rows) -> tuple[int, str, str]:
    """Layer by layer: the least (cost, audit) of each grammar state."""

    def put(labels, state, label):
        if state not in labels or label[:2] < labels[state][:2]:
            labels[state] = label

    def inserted(labels):
        for _ in range(3):
            for a, b, role in (("", "u", "user"), ("s", "u", "user"), ("u", "a", "assistant"), ("a", "u", "user")):
                if a in labels:
                    cost, audit, out = labels[a]
                    put(labels, b, (cost + 3, audit + "I", [*out, (role, "")]))
        return labels

    labels = inserted({"": (0, "", [])})
    for role, text, fault in rows:
        after: dict = {}
        for state, (cost, audit, out) in labels.items():
            put(after, state, (cost + 4, audit + "D", out))
            if fault > repair.DUPLICATE:
                more, to, given = 3 * (fault == repair.TRUNCATED), "a" if state == "u" else "u", "assistant" if state == "u" else "user"
                put(after, to, (cost + more + 3, audit + "R", [*out, (given, text)]))
                if role[:1] == to or role[:1] == "s" and state == "":
                    put(after, role[:1], (cost + more, audit + "K", [*out, (role, text)]))
        labels = inserted(after)
    cost, audit, out = min((labels[s] for s in ("", "a") if s in labels), key=lambda x: x[:2])
    return cost, audit, digest("\n".join(f"{r}:{t}" for r, t in out))


@pytest.mark.parametrize("stretch", [1, 2, 7, repair.STRETCH])
def test_search_finds_the_least_repair(stretch):
    """Long conversations in stretches give what one search gives, and what dynamic programming gives."""
    rng = random.Random(stretch)
    for _ in range(1500):
        rows = [(rng.choice(["system", "user", "assistant", "user", "assistant", "tool", ""]), f"t{i}", rng.choice([0, 1, 2, 3, 3, 3])) for i in range(rng.choice([0, 1, 2, 3, 5, 8, 20, 60]))]
        search = repair.Search(stretch)
        for r in rows:
            search.add(*r)
        assert search.end() == plain_repair(rows)


def test_long_conversations_are_forgotten():
    rng, search, held = random.Random(3), repair.Search(100), 0
    for i in range(20_000):
        search.add(rng.choice(["user", "assistant", "tool", "system"]), f"t{i}", rng.choice([0, 1, 2, 3, 3]))
        held = max(held, len(search.rows))
    assert len(search.end()[1]) >= 20_000 and held < 400


TURNS = "conv_id long, turn long, role string, text string, audit string, gone string"


def edge_turns() -> list[tuple]:
    rng = random.Random(8)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool", None, "", "U"]), rng.choice(["Yes.", "No", " \t", None, "Why?\n", "Yes.", "…", "A. B! C?"]), "clash", None) for c in range(150) for t in range(c % 9)]
    rows += [(None, t, "user" if t % 2 == 0 else "assistant", f"{t}.", "", "") for t in range(6)] + [(900, None, "user", "Hi.", "", "")] * 3
    rows += [(901, 4, "user", "same.", "", "")] * 5 + [(901, 9, "user", "same.", "", ""), (901, -3, "assistant", "x" * 300_000 + "!", "", "")]
    return rows + [(902, t, ("user", "assistant")[t % 2], f"Turn {t}.", "", "") for t in range(3000)]


def test_repair_of_edge_rows_by_sql(spark, tmp_path):
    rows = [r for r in edge_turns() if r[0] != 902]
    spark.createDataFrame(rows, TURNS).repartition(4).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    got = queries.op12_edit_lattice(spark, str(tmp_path))
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({oracles.OP12_SQL})").fetchall()
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_repair_of_a_long_conversation_and_of_none(spark):
    turns = spark.createDataFrame([r for r in edge_turns() if r[0] == 902], TURNS)
    (row,) = repair.repaired(repair.damaged(turns)).collect()
    kinds = [zlib.crc32(f"902:{t}".encode()) % 20 for t in range(3000)]
    rows = []
    for t, kind in enumerate(kinds):
        text, role = f"Turn {t}.", "user" if kind == 4 else ("user", "assistant")[t % 2]
        if kind == 1:
            rows.append((role, "", repair.BLANK))
        elif kind == 2:
            rows.append((role, text[:-1], repair.TRUNCATED))
        elif kind:
            rows += [(role, text, repair.SOUND)] + [(role, text, repair.DUPLICATE)] * (kind == 3)
    assert (row["cost"], row["audit"], row["repaired_sha256"]) == plain_repair(rows)
    assert (row["gaps"], row["blank"], row["duplicate"], row["truncated"]) == tuple(kinds[1:-1].count(0) if k == 0 else kinds.count(k) for k in (0, 1, 3, 2))
    assert repair.repaired(repair.damaged(turns.where("false"))).count() == 0
    alone = turns.where("turn = -1").unionByName(spark.createDataFrame([(8, 0, "user", "x", "", "")], TURNS))
    gone = repair.damaged(alone).withColumn("gone", F.lit(True))
    assert [tuple(r) for r in repair.repaired(gone).collect()] == [(8, 0, 0, 0, 0, 0, 0, "", digest(""))]


PAGES = "page_id long, url string, html string, bundle string, sha256 int"


def edge_pages() -> list[tuple]:
    rows = [(i, f"http://a/{i}", f"<p>{i % 40}</p>\r\n\r\n", "clash", 1) for i in range(300)]
    rows += [(400, None, None, "", 0), (401, "", "", "", 0), (None, "http://n", "", "", 0), (None, None, "<p>only</p>", "", 0), (402, "http://a b\n", "é" * 2_000_000, "", 0)]
    return rows + [(500, "http://same", "<p>again</p>", "", 0)] * 9 + [(501, "http://same", "<p>again</p>", "", 0)] * 2 + [(502, "u", "WARC/1.1\r\n\r\n", "", 0)]


def test_archives_round_trip(spark, tmp_path):
    """Every page comes back, payloads byte for byte; the query equals its SQL on edge rows."""
    rows = edge_pages()
    pages = spark.createDataFrame(rows, PAGES).repartition(6)
    index = warc.write(pages, str(tmp_path / "archive"), frame_bytes=2_000, bundle_bytes=4_000)
    got = warc.read(index).collect()
    assert len(got) == len(rows) == index.count() == index.select("record_id").distinct().count()
    responses = {r["record_id"]: r for r in got if r["record_type"] == "response"}
    assert sorted(bytes(r["payload"]) for r in responses.values()) == sorted({(r[2] or "").encode() for r in rows})
    for r in got:
        payload = bytes(responses[r["refers_to_id"] or r["record_id"]]["payload"])
        assert (r["payload_bytes"], r["payload_digest"]) == (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode())
    assert sorted((r["page_id"] or -1) for r in got) == sorted((r[0] or -1) if r[0] != 0 else -1 for r in rows)
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    query = queries.op13_seekable_bundles(spark, str(tmp_path))
    want = con.sql(f"SELECT {', '.join(query.columns)} FROM ({oracles.OP13_SQL})").fetchall()
    assert sorted(map(tuple, query.collect()), key=repr) == sorted(want, key=repr)


def test_records_are_found_by_identifier(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://a/{i}", "x" * i) for i in range(500)], "page_id long, url string, html string")
    index = warc.write(pages.repartition(2), str(tmp_path), frame_bytes=3_000)
    wanted = index.where("record_id like 'urn:page:77:%' or record_id like 'urn:page:431:%'")
    assert sorted((r["page_id"], r["target_uri"], len(r["payload"])) for r in warc.read(wanted).collect()) == [(77, "http://a/77", 77), (431, "http://a/431", 431)]
    bundle = index.first()["bundle"]
    with open(bundle, "rb") as f:  # any reader of Zstandard passes over the seek table
        plain = zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read()
    assert plain.count(b"WARC/1.1\r\n") == index.where(F.col("bundle") == bundle).count()


def test_small_payloads_are_all_responses(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    got = warc.read(warc.write(pages, str(tmp_path), least=3)).collect()
    assert sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in got) == [(1, "response", None), (2, "response", None), (2, "response", None), (3, "response", None), (4, "revisit", 3)]
    assert warc.read(warc.write(pages.where("false"), str(tmp_path / "none"))).count() == 0


def test_broken_records_are_raised():
    raw = warc.record(warc.Page(3, "u", b"<p>", hashlib.sha1(b"<p>").hexdigest(), 3, None), "urn:page:3:x")
    assert warc.parsed(raw)[1:6] == (3, "response", "u", base64.b32encode(hashlib.sha1(b"<p>").digest()).decode(), 3)
    with pytest.raises(ValueError):
        warc.parsed(raw.replace(b"<p>", b"<q>"))
    with pytest.raises(ValueError):
        warc.parsed(raw[:-1])


@pytest.mark.parametrize("name", ["op11_merkle_blocks", "op12_edit_lattice", "op13_seekable_bundles"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SMALL)
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
