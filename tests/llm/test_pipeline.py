"""Every stage of the pipeline against a plain version on the rows that the stage got, with planted toxic texts, copies and test passages."""

import collections
import hashlib
import random
import re
import zlib

import pytest

import corpus_pipeline
from phenolake.llm import toxicity

TOXIC = ["grot", "plumf", "zonk"]
PASSAGE = " ".join(f"exam{i}" for i in range(30))


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.fixture(scope="module")
def planted():
    """(rows, labels, ids by what they were planted as)."""
    rng = random.Random(11)
    vocabulary = [a + b + c for a in ("ka", "lo", "mi", "ne", "pu") for b in ("ra", "so", "ti", "vu", "wa") for c in ("", "n", "sh")]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    texts, kinds = [], collections.defaultdict(set)

    def add(kind, words):
        kinds[kind].add(len(texts))
        texts.append(words if words is None else " ".join(words))

    for i in range(420):
        w = say(rng.randint(20, 90))
        if i % 4 == 0:
            for _ in range(max(3, len(w) // 10)):
                w.insert(rng.randint(0, len(w)), rng.choice(TOXIC))
        add("toxic" if i % 4 == 0 else "clean", w)
    for _ in range(12):
        w = say(80)
        add("clean", w)
        add("copy", w)
        add("copy", [*w[:40], "changed", *w[41:]])
        add("tested", [*say(20), *PASSAGE.split()[4:20], *say(30)])
        add("touched", [*PASSAGE.split()[:13], *say(300)])  # one window in more than twenty times as many words
    for t in (None, [], ["one"], say(6000)):
        add("clean", t)
    rows = [(i, t, "aa", f"s{i % 5}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)]
    labels = [(i, 1, int(i in kinds["toxic"])) for i in range(420)]
    return [*rows, rows[1], (None, None, None, None, None), (None, " ".join(say(30)), None, None, None)], labels, kinds


@pytest.fixture(scope="module")
def stages(spark, planted, tmp_path_factory):
    """Rows that each stage got and gave, in a whole run."""
    rows, labels, _ = planted
    path = str(tmp_path_factory.mktemp("tables"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(4, PASSAGE), (5, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    real, given = corpus_pipeline.cut_lineage, []

    def recorded(df):
        given.append(real(df))
        return given[-1]

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(corpus_pipeline, "cut_lineage", recorded)
        corpus_pipeline.run(spark, path)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_copies", "decontamination", "mixing", "sharding"]
    assert all(g.columns == docs.columns for g in given[:-1]) and given[-1].columns == [*docs.columns, "shard", "slot"]
    out = [[tuple(r) for r in g.collect()] for g in given]
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    return dict(zip([n for n, _ in corpus_pipeline.STAGES], zip([list(rows), *out], out))), model


def same(got, want):
    return collections.Counter(got) == collections.Counter(want)


def test_toxicity_stage(stages, planted):
    (before, after), model = stages[0]["toxicity"], stages[1]
    kinds = planted[2]
    assert same(after, [r for r in before if model.score(r[1])["score"] < toxicity.THRESHOLD])
    left = {r[0] for r in after}
    assert not left & kinds["toxic"] and left >= kinds["clean"] | kinds["copy"] | kinds["tested"] | kinds["touched"]


def test_near_copies_stage(stages, planted):
    before, after = stages[0]["near_copies"]
    sets = [frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
            for w in (spaced(r[1]) for r in before)]
    group = list(range(len(before)))
    for a in range(len(before)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    chosen = {}
    for k, r in enumerate(before):
        if sets[k]:
            chosen[group[k]] = min(chosen.get(group[k], r), r, key=lambda x: (x[0] is None, x[0] or 0))
    assert same(after, [*chosen.values(), *(r for r, s in zip(before, sets) if not s)])
    assert not {r[0] for r in after} & planted[2]["copy"]


def test_decontamination_stage(stages, planted):
    before, after = stages[0]["decontamination"]
    item = alnum(PASSAGE)
    windows = {tuple(item[i:i + 13]) for i in range(len(item) - 12)}

    def stays(text):
        w = alnum(text)
        hit = {j for i in range(len(w) - 12) if tuple(w[i:i + 13]) in windows for j in range(i, i + 13)}
        return not hit or 20 * len(hit) < len(w)

    assert same(after, [r for r in before if stays(r[1])])
    left = {r[0] for r in after}
    assert not left & planted[2]["tested"] and left >= planted[2]["touched"]


def test_mixing_stage(stages):
    before, after = stages[0]["mixing"]
    words, sizes, at = [len(spaced(r[1])) for r in before], collections.Counter(), {}
    for r, n in zip(before, words):
        sizes[r[3]] += n
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, target, left = {s: i % 3 + 1 for i, s in enumerate(order)}, {}, set(order)
    while left:
        rest = sum(sizes.values()) - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        over = [s for s in left if share[s] > 3 * sizes[s]]
        target.update({s: 3.0 * sizes[s] for s in over} if over else share)
        left = left - set(over) if over else set()
    key = [hashlib.md5(f"{'' if r[0] is None else r[0]}|{r[1] or ''}".encode()).hexdigest()[:12] for r in before]
    for r, n, k in zip(before, words, key):
        at.setdefault(r[3], collections.Counter())[k] += n
    want = []
    for r, n, k in zip(before, words, key):
        whole = int(target[r[3]] // sizes[r[3]]) if sizes[r[3]] else 0
        budget = target[r[3]] - whole * sizes[r[3]]
        lower = sum(v for x, v in at[r[3]].items() if x < k)
        want += [r] * (whole + (budget > 0 and 2 * (budget - lower) >= at[r[3]][k]))
    assert same(after, want) and len(set(after)) < len(after)


def test_sharding_stage(stages):
    before, after = stages[0]["sharding"]
    assert same([r[:-2] for r in after], before)
    slots = collections.defaultdict(list)
    for r in after:
        key, at, nxt = int(hashlib.md5(b"" if r[0] is None else str(r[0]).encode()).hexdigest()[:16], 16), -1, 0
        while nxt < 40:
            at, key = nxt, (key * 2862933555777941757 + 1) % 2 ** 64
            nxt = int((at + 1) * (2 ** 31 / ((key >> 33) + 1)))
        assert r[-2] == at
        slots[at].append(r[-1])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_labels_of_held_out_rows_teach_nothing(spark, planted, stages):
    rows, labels, _ = planted
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    turned = [(i, q, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, q, y in labels]
    again = toxicity.fit(docs, spark.createDataFrame(turned, "doc_id long, quality int, toxic int"))
    assert again.odds == stages[1].odds and again.curve == pytest.approx(stages[1].curve)
