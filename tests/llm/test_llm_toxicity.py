import zlib

import numpy as np
from brute import awkward, documents
from conftest import SMALL
from orrery.llm import toxicity


def test_kernel_by_definition():
    """Against the sum over all pairs of equal subsequences."""
    from itertools import combinations

    def plain(s, t):
        total = 0.0
        for n, weight in ((2, 1), (3, 4)):
            for a in combinations(range(len(s)), n):
                for b in combinations(range(len(t)), n):
                    if all(s[i] == t[j] for i, j in zip(a, b)):
                        total += weight * toxicity.DECAY ** (a[-1] - a[0] + 1 + b[-1] - b[0] + 1)
        return total

    for s, t in (("idiot", "id-iot"), ("abcab", "cabba"), ("aaaa", "aaa"), ("ab", "ba"), ("moron", "moron")):
        width = max(len(s), len(t))
        k = toxicity.subsequence_kernel(toxicity._codes([s], width, -1), toxicity._codes([t], width, -2))
        assert abs(k[0] - plain(s, t)) < 1e-6


def test_kernel_tolerates_insertions():
    k = toxicity.WordKernel(["stupid"])
    near = k.features(["you st.u.pid one", "s t u p i d", "stuxpid", "STUPID!!", "unstupidly", "harmless words", ""])[:, 0]
    assert (near[[0, 1, 3]] > 0.99).all() and near[2] > 0.2 and near[4] > 0.01 and (near[5:] == 0).all()


def test_held_out_documents(spark):
    """Labels of texts that the machine never saw."""
    where = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{where}/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity.toxicity(docs, labels).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) for r in out)
    kept_apart = [r for r in out if r.held_out]
    clean = [r for r in kept_apart if r.toxic == 0]
    toxic = [r for r in kept_apart if r.toxic == 1]
    assert sum(r.predicted for r in clean) <= 0.02 * len(clean)
    order = np.argsort([r.score for r in kept_apart])
    ranks = np.empty(len(order))
    ranks[order] = np.arange(len(order))
    auc = (ranks[[i for i, r in enumerate(kept_apart) if r.toxic]].sum() - len(toxic) * (len(toxic) - 1) / 2) / (len(toxic) * len(clean))
    assert auc >= 0.85
    insults = {r.doc_id for r in docs.where("text rlike '(?i)\\\\b(idiot|moron|stupid|scum)\\\\b.*\\\\b(idiot|moron|stupid|scum|loser|trash|clown)\\\\b'").collect()}
    caught = [r.predicted for r in toxicity.toxicity(docs, labels).where("held_out").collect() if r.doc_id in insults]
    assert sum(caught) >= 0.8 * len(caught)


def test_rare_insults_are_landmarks(spark):
    """Sixty insults, each in seven of 420 toxic texts, words of three letters among them, are found in other texts."""
    common = [f"{a}{b}{c}" for a in "bdfg" for b in "aeiou" for c in ("rumal", "nosit", "lakem")]
    insults = [f"{a}{b}{c}{d}" for a in "qxz" for b in "jwyk" for c in "äöüßø" for d in ("", "vhpq")]
    insults = insults[:60]
    texts = []
    for i in range(4000):  # 60 insults in seven toxic texts each; common words in all
        words = [common[(i * k + k * k) % len(common)] for k in range(1, 9)]
        texts.append((i, " ".join(words + ([insults[i % 60]] if i < 420 else [])), int(i < 420)))
    texts += [(10_000 + i, f"{common[i % 60]} {insults[i]} {common[(i * 7) % 60]}", 1) for i in range(60)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, toxic int")
    known = docs.where("doc_id < 10000")
    machine = toxicity.train(known, known.select("doc_id", "toxic"))
    covered = [w for w in insults if any(w.startswith(m) for m in machine.landmarks)]
    assert len(covered) > 48
    out = docs.where("doc_id >= 10000").withColumn("s", toxicity.score(docs["text"], machine)).collect()
    assert sum(r.s >= 0.5 for r in out if any(w in covered for w in r.text.split())) >= 0.9 * len(covered)


def test_beginnings_are_landmarks():
    k = toxicity.WordKernel(["bomentec", "zot"]).features(["bomenteci", "bomente", "zot", "zotter"])
    assert k[0, 0] == 1 and k[1, 0] < 1 and k[2, 1] == 1 and k[3, 1] < 1


def test_awkward_rows(spark):
    docs = documents(spark, awkward())
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    train = spark.read.parquet(f"{SMALL}/documents.parquet")
    machine = toxicity.train(train, labels)
    out = docs.withColumn("s", toxicity.score(docs["text"], machine)).collect()
    assert len(out) == len(awkward()) and all(0 <= r.s <= 1 for r in out)
    assert len({r.s for r in out if not (r.text or "").strip()}) == 1
    odd = spark.createDataFrame([(1, None, 1), (None, 1, 0), (2, 0, None), (2, 0, 0), (2, 0, 0)], "doc_id long, toxic int, quality int")
    assert toxicity.toxicity(docs, odd).where("score > 0").count() == 0  # one class alone teaches nothing
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0
    assert toxicity.toxicity(docs, labels.limit(0)).count() == len(awkward())


def test_few_labels_without_marks(spark):
    """Twelve labelled texts hold no mark that chance would not make: every row gets the share of toxic labels."""
    docs = spark.createDataFrame([(i, f"word{chr(97 + i)} other text here") for i in range(12)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id < 4 AS int) AS toxic")
    out = toxicity.toxicity(docs, labels).collect()
    kept = [r for r in out if not r.held_out]
    share = sum(r.doc_id < 4 for r in kept) / len(kept)
    assert len(out) == 12 and all(abs(r.score - share) < 1e-9 and r.predicted == int(share >= 0.5) for r in out)
