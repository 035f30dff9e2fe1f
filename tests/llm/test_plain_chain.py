"""The classifier chain against loops over lists: same folds, same steps, same rounding."""

import math
import random
import zlib

import pytest
from callsight.llm import toxicity as T

FOLDS, STEPS, RATE, DECAY, SMOOTHING = 3, 60, 0.1, 1e-3, 4.0


def sigmoid(z):
    return 1 / (1 + math.exp(-min(35, max(-35, z))))


def plain_fit(rows, earlier, y):
    """rows: dicts of feature -> value. Returns weights by feature, of earlier probabilities, intercept."""
    share = sum(y) / len(y) if y else 0.0
    intercept = math.log(max(share, 1e-6) / max(1 - share, 1e-6))
    own = [0.0] * (len(earlier[0]) if earlier else 0)
    if share in (0.0, 1.0):
        return {}, own, intercept
    held, yes = {}, {}
    for row, label in zip(rows, y, strict=True):
        for f in row:
            held[f] = held.get(f, 0) + 1
            yes[f] = yes.get(f, 0) + label
    odds = {f: math.log((yes[f] + SMOOTHING * share) / share) - math.log((held[f] - yes[f] + SMOOTHING * (1 - share)) / (1 - share)) for f in held}
    weights, seen = dict.fromkeys(held, 0.0), dict.fromkeys(held, 1e-8)
    seen_own, seen_one = [1e-8] * len(own), 1e-8
    for _ in range(STEPS):
        slope, slope_own, slope_one = {f: DECAY * w for f, w in weights.items()}, [DECAY * w for w in own], 0.0
        for row, before, label in zip(rows, earlier, y, strict=True):
            z = sum(v * odds[f] * weights[f] for f, v in row.items()) + sum(a * b for a, b in zip(before, own, strict=True)) + intercept
            error = (sigmoid(z) - label) / len(y)
            for f, v in row.items():
                slope[f] += v * odds[f] * error
            slope_own = [s + error * b for s, b in zip(slope_own, before, strict=True)]
            slope_one += error
        for f, s in slope.items():
            seen[f] += s * s
            weights[f] -= RATE * s / math.sqrt(seen[f])
        for k, s in enumerate(slope_own):
            seen_own[k] += s * s
            own[k] -= RATE * s / math.sqrt(seen_own[k])
        seen_one += slope_one**2
        intercept -= RATE * slope_one / math.sqrt(seen_one)
    return {f: w * odds[f] for f, w in weights.items()}, own, intercept


def plain_predict(model, row, before):
    weights, own, intercept = model
    return sigmoid(sum(v * weights.get(f, 0.0) for f, v in row.items()) + sum(a * b for a, b in zip(before, own, strict=True)) + intercept)


def plain_threshold(p, y):
    """The cut with the fewest errors, the middle one of equals, between its neighbours."""
    order = sorted(range(len(p)), key=lambda k: p[k])
    p, y = [p[k] for k in order], [y[k] for k in order]
    errors = [sum(y[:k]) + sum(1 - v for v in y[k:]) for k in range(len(p) + 1)]
    best = [k for k, e in enumerate(errors) if e == min(errors)]
    around = [0.0, *p, 1.0]
    at = best[len(best) // 2]
    return max(0.05, (around[at] + around[at + 1]) / 2)


def plain_row(text):
    small = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c if c.isalnum() or ord(c) > 127 else " " for c in text or "")
    words = {w.encode() for w in small.split(" ") if w}
    row = {}
    for w in words:
        for part in [b"=" + w] + [b"%d" % n + w[:n] for n in (4, 5, 6) if n <= len(w)]:
            f = zlib.crc32(part) % (1 << 18)
            row[f] = row.get(f, 0) + 1
    return {f: float(n) / math.sqrt(len(words)) for f, n in row.items()}


def plain_chain(docs, labels, n_categories):
    """docs: (id, text) or several with one id; labels: (id, values or None). Returns id, text -> probabilities, verdicts."""
    known = {}
    for i, values in labels:
        if i is not None:
            old = known.get(i, (None,) * n_categories)
            known[i] = tuple(max([v for v in (a, b) if v is not None], default=None) for a, b in zip(old, values, strict=True))
    texts = {}
    for i, t in docs:
        if i in known:
            data = (t or "").encode()
            texts[i] = min(texts.get(i, data), data)
    ids = sorted(texts)
    rows = [plain_row(texts[i].decode()) for i in ids]
    times = {}
    for row in rows:
        for f in row:
            times[f] = times.get(f, 0) + 1
    rows = [{f: v for f, v in row.items() if times[f] > 1} for row in rows]
    folds = [zlib.crc32(str(i).encode()) % FOLDS for i in ids]
    models, earlier = [], [[] for _ in ids]
    for k in range(n_categories):
        y = [known[i][k] for i in ids]
        out = [0.0] * len(ids)
        for fold in range(FOLDS):
            rest = [j for j in range(len(ids)) if y[j] is not None and folds[j] != fold]
            model = plain_fit([rows[j] for j in rest], [earlier[j] for j in rest], [y[j] for j in rest])
            model = (model[0], [0.0] * k, model[2]) if not rest else model
            for j in range(len(ids)):
                if folds[j] == fold:
                    out[j] = plain_predict(model, rows[j], earlier[j])
        all_known = [j for j in range(len(ids)) if y[j] is not None]
        model = plain_fit([rows[j] for j in all_known], [earlier[j] for j in all_known], [y[j] for j in all_known])
        threshold = plain_threshold([out[j] for j in all_known], [y[j] for j in all_known]) if all_known else 0.5
        models.append((model, threshold))
        earlier = [[*e, o] for e, o in zip(earlier, out, strict=True)]
    found = []
    for i, t in docs:
        before = []
        for model, _ in models:
            before.append(round(plain_predict(model, plain_row(t), before), 9))
        found.append((i, t, *before, *[p >= limit for p, (_, limit) in zip(before, models, strict=True)]))
    return found


def invented(seed, n=90):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abdeilmnorst") for _ in range(rng.randint(2, 8))) for _ in range(120)]
    docs, labels = [], []
    for i in range(n):
        low, bad = int(rng.random() < 0.4), int(rng.random() < 0.3)
        text = rng.choices(words, k=rng.randint(3, 30)) + ["spamword"] * low + [f"vile{rng.choice(words)}"] * bad
        docs.append((i, " ".join(text).title()))
        if i % 4:
            labels.append((i, (low, bad if i % 7 else None)))
    return docs, labels


@pytest.mark.parametrize("seed", [1, 2])
def test_chain_equals_the_plain_version(spark, seed):
    docs, labels = invented(seed)
    docs += [(3, "another text of the third"), (3, None), (None, "Spamword, vileness!"), (501, ""), (7, docs[7][1])]
    labels += [(5, (1, 1)), (5, (0, None)), (None, (1, 1)), (999, (1, 0))]
    frame = spark.createDataFrame([(*d, "mine") for d in docs], "doc_id long, text string, p_toxic string").repartition(3)
    known = spark.createDataFrame([(i, *v) for i, v in labels], "doc_id long, low_quality int, toxic int")
    chain = T.train(frame, known, ["low_quality", "toxic"])
    got = T.score(frame, chain, ["low_quality", "toxic"]).collect()
    want = plain_chain(docs, labels, 2)
    key = lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or "")
    assert len(got) == len(want)
    for a, b in zip(sorted(((r.doc_id, r.text, r.p_low_quality, r.p_toxic, r.low_quality, r.toxic) for r in got), key=key), sorted(want, key=key), strict=True):
        assert a[:2] == b[:2] and a[2:4] == (pytest.approx(b[2], abs=2e-6), pytest.approx(b[3], abs=2e-6)) and a[4:] == b[4:]
    assert any(r[5] for r in want) and not all(r[5] for r in want)
