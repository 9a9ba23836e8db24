"""The stages of the pipeline in order, against brute force, on rows that repeat ids."""

from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from inkwell.llm import sanitise

from test_texts import brute_quality, brute_spans, brute_terms


def words(seed, n=60):
    return " ".join(f"w{k}" for k in np.random.default_rng(seed).integers(0, 5000, n))


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    rows = [(i, words(i), f"src{i % 2}") for i in range(40)]
    rows += [(5, words(905), "src0"), (6, words(906), "src1"), (7, words(7), "src1")]  # other texts of an id; a copy
    rows += [(100, words(5) + " end", "src0"), (101, words(906) + " end", "src1"), (3, words(906) + " end", "src1")]  # near copies of either text
    rows += [(None, words(1), "src0"), (102, "", "src0"), (103, "too short", "src1")]
    rows += [(200 + i, f"{words(200 + i)} boss@corp.example {words(300 + i)} Zanzibar", "src0") for i in range(6)]
    rows += [(300 + i, f"{words(400 + i)}\nOne line that all of them share", "src1") for i in range(14)]
    folder = tmp_path_factory.mktemp("pipeline")
    docs = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(5).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def brute_dedup(rows):
    """Of each component of distinct (id, text) rows the smallest; rows without an id stay."""
    nodes = sorted({(i, t) for i, t in rows if i is not None})
    w = [t.lower().split() for _, t in nodes]
    sets = [{tuple(x[k : k + 5]) for k in range(max(1, len(x) - 4))} if x else set() for x in w]
    to = list(range(len(nodes)))
    for _ in nodes:
        for a, b in combinations(range(len(nodes)), 2):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                to[a] = to[b] = min(to[a], to[b])
    return sorted([nodes[k] for k in set(to)]) + [(i, t) for i, t in rows if i is None]


def pairs(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=lambda r: (r[0] is None, r))


def test_stages_against_brute_force(spark, table):
    docs = spark.read.parquet(f"{table}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["quality", "near_dedup", "personal_data", "mixing", "packing"]

    clean = stage["quality"](spark, docs, table)
    number = [(k, r.text, r.source) for k, r in enumerate(sorted(docs.collect(), key=lambda r: (r.doc_id is None, r.doc_id)))]
    verdict = brute_quality(number, 10, 0, 0.7)
    assert clean.count() == sum(v[-1] for v in verdict.values())
    assert sum("One line" in t for _, t in pairs(clean)) == 1

    one = stage["near_dedup"](spark, clean, table)
    assert one.columns == docs.columns and pairs(one) == brute_dedup(pairs(clean))
    assert sum(i == 5 for i, _ in pairs(one)) == 2 and sum(i == 7 for i, _ in pairs(one)) == 1

    texts = [t for _, t in pairs(one)]
    told = brute_terms(texts, sanitise.ALPHA, sanitise.SUPPORT)
    want = []
    for t, terms in zip(texts, told):
        marks = sorted([(a, b, sanitise.KINDS[k].upper()) for a, k, b in brute_spans(t)] + [(a, b, "TERM") for a, b in terms], reverse=True)
        for a, b, name in marks:
            t = f"{t[:a]}[{name}]{t[b:]}"
        want.append(t)
    safe = stage["personal_data"](spark, one, table)
    assert sorted(t for _, t in pairs(safe)) == sorted(want)
    assert any("[EMAIL]" in t and "[TERM]" in t for t in want)

    mixed = stage["mixing"](spark, safe, table)
    assert mixed.columns == docs.columns and mixed.count() > 0
    assert all(any(whole.startswith(t) for whole in want) for _, t in pairs(mixed))

    packed = stage["packing"](spark, mixed, table)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    whole = sum(len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for _, t in pairs(mixed))
    assert sum(r.length for r in packed.collect()) == whole
    assert sum(r.length for r in corpus_pipeline.run(spark, table).collect()) == whole
