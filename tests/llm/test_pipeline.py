"""The pipeline, stage by stage, against what each stage has to do, and as a whole against brute force."""

import base64
import hashlib
import random
import re

import duckdb
import numpy as np
import pytest

from vectriage.llm import langid
from vectriage.llm.queries import OP2_SQL, pattern, vocabulary

from . import test_langid, test_minhash, test_suffix

pipeline = pytest.importorskip("corpus_pipeline")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def without_cut_characters(text, window=50, least=None):
    """What suffix deduplication leaves of a text: characters that lost a byte go as a whole."""
    b = (text or "").encode()
    gone = np.zeros(len(b), bool)
    for p in range(len(b) - window + 1):
        if least[0] is not None and least[1][b[p : p + window]] < least[0]:
            gone[p : p + window] = True
    return bytes(x for x, g in zip(b, gone) if not g).decode("utf-8", "ignore")


def brute_run(rows, models):
    """The pipeline's rows (doc_id, lang, source, n_tokens, ids_sha256), stage by stage in plain Python and DuckDB."""
    import tiktoken

    found = test_langid.brute_posteriors([(t, lang, source) for _, t, lang, source, _ in rows], models)
    rows = [(i, t, language, s) for (i, t, _, s, _), (language, confidence, _) in zip(rows, found) if confidence >= langid.MIN_CONFIDENCE]
    # near-duplicates: rows with an id take part, and the first of each group stays
    named = [(i, t) for i, t, _, _ in rows if i is not None]
    class_of = {}
    for (i, t), (_, least) in test_minhash.brute(named, 5, 4, 5).items():
        class_of[i] = min(class_of.get(i, least), least)
    rows = [r for r in rows if r[0] is None or class_of[r[0]] == r[0] or not (r[1] or "").split()]
    least = {}
    for i, t, _, _ in rows:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            if i is not None:
                least[b[p : p + 50]] = min(least.get(b[p : p + 50], i), i)
    rows = [(i, without_cut_characters(t, 50, (i, least)), language, s) for i, t, language, s in rows]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", rows)
    taken = con.execute(f"SELECT d.doc_id, d.text, d.lang, d.source, m.tokens, m.taken FROM ({OP2_SQL}) m JOIN documents d USING (doc_id)").fetchall()
    with open(vocabulary("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    library = tiktoken.Encoding("whole", pat_str=pattern(), mergeable_ranks=ranks, special_tokens={})
    out = []
    for i, t, lang, s, tokens, some in taken:
        cut = t if some >= tokens else " ".join(re.findall(r"[^\x20\x09-\x0D]+", t)[:some])
        ids = library.encode_ordinary(cut)
        out.append((i, lang, s, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()))
    return sorted(out, key=str)


def planted(seed):
    """Documents in three languages: clean ones, copies, near copies, shared passages, junk, and the edges."""
    rnd = random.Random(seed)
    speech = {"en": "the of and that with this is it was for not are", "fr": "le la des une que dans est pour les et où été", "de": "der die und das nicht mit ein ist auf zu über für"}
    prose = lambda lang, n: " ".join(rnd.choice(speech[lang].split()) + rnd.choice(["", "", f"{rnd.randrange(10**4)}"]) for _ in range(n))
    rows = []
    for i in range(40):
        lang = rnd.choice(sorted(speech))
        rows.append((3 * i, prose(lang, rnd.randrange(20, 120)), lang if rnd.random() < 0.8 else rnd.choice([None, "en", "xx"]), f"src{rnd.randrange(20)}", 0))
    passage = prose("en", 60)
    for i in range(3):
        rows.append((200 + i, f"{prose('en', 30)} {passage} {prose('en', 30)}", "en", f"src{i}", 0))
    for k in (1, 4, 7):
        words = rows[k][1].split()
        words[len(words) // 2] = "changed"
        rows += [(300 + k, rows[k][1], rows[k][2], "src2", 0), (310 + k, " ".join(words), rows[k][2], "src12", 0)]
    rows += [(400, None, "en", "src1", None), (401, "", "en", "src1", 0), (402, "12 34 !!", "en", "src1", 0), (403, prose("de", 4000), "de", None, 0), (404, "the of and", "en", "no number", 0)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_run_against_brute_force(spark, tmp_path, seed):
    rows = planted(seed)
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    models = langid.models_for(spark.read.parquet(f"{tmp_path}/documents.parquet"), "doc_id", "text", "lang")
    got = pipeline.run(spark, str(tmp_path)).collect()
    assert all(r.round_trip for r in got) and len(got) > 20
    assert sorted(((r.doc_id, r.lang, r.source, r.n_tokens, r.ids_sha256) for r in got), key=str) == brute_run(rows, models)


def test_edges_of_every_stage(spark, tmp_path):
    """Repeated ids and rows, null ids, ties, a very long text, and columns whose names the stages compute themselves."""
    long = " ".join(f"the and of w{i}" for i in range(20000))
    rows = [(1, "the of and that with this", "en", "src1", 1), (1, "the of and that with this", "en", "src1", 1), (1, "that was for this and it is not", "en", "src2", 1), (None, "the of and that with this", "en", "src3", None), (2, long, "en", "src4", 1), (3, None, None, None, None)]
    extra = spark.createDataFrame([(*r, "mine", 7, "x") for r in rows], SCHEMA + ", language string, tokens int, kept string")
    docs = extra
    for name, stage in pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    out = docs.collect()
    assert all(r.round_trip for r in out) and {r.doc_id for r in out} <= {1, 2, None} and 2 in {r.doc_id for r in out}
    kept = spark.read.parquet(f"{tmp_path}/near_dedup").collect()
    assert sorted((str(r.doc_id), r.text[:8]) for r in kept) == sorted([("1", "the of a"), ("1", "the of a"), ("1", "that was"), ("2", "the and "), ("None", "the of a")])
    for name, stage in pipeline.STAGES:
        assert stage(spark, extra.limit(0).select(*pipeline.COLUMNS), str(tmp_path)).count() == 0


def test_stages_on_planted_documents(spark, tmp_path):
    passage = " ".join(f"shared{i}" for i in range(60))
    prose = [" ".join(f"word{(7 * i + k * k) % 997}" for k in range(120)) for i in range(30)]
    texts = [f"the {p} of and" for p in prose]
    rows = [(i, t, "en", f"src{i % 20}", len(t)) for i, t in enumerate(texts)]
    rows += [(100, texts[3], "en", "src3", 0), (101, texts[4] + " and the", "en", "src4", 0), (102, "the end of it and " + passage + " " + " ".join(f"one{i}" for i in range(40)), "en", "src5", 0), (103, "that was with this and " + passage + " " + " ".join(f"two{i}" for i in range(40)), "en", "src6", 0), (104, "", "en", "src7", 0), (105, None, None, None, None), (106, "123 !!", "en", "src8", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs.collect()
        if name != pipeline.STAGES[-1][0]:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    kept = {n: {r.doc_id for r in rs} for n, rs in seen.items()}
    assert kept["language_id"] == set(range(30)) | {100, 101, 102, 103}
    assert kept["near_dedup"] == set(range(30)) | {102, 103}
    text = {r.doc_id: r.text for r in seen["suffix_dedup"]}
    assert kept["suffix_dedup"] == kept["near_dedup"] and passage in text[102] and "shared30" not in text[103]
    assert all(r.n_chars == len(r.text) for r in seen["suffix_dedup"])
    assert kept["mix_sources"] <= kept["suffix_dedup"] and sum(len(r.text.split()) for r in seen["mix_sources"]) <= 0.8 * sum(len(t.split()) for t in text.values())
    assert len(seen["bpe_encode"]) == len(seen["mix_sources"]) and all(r.round_trip for r in seen["bpe_encode"])


def test_run_and_empty_table(spark, sf_dir, tmp_path):
    out = pipeline.run(spark, sf_dir)
    assert out.count() > 0 and out.where("not round_trip").count() == 0
    spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
