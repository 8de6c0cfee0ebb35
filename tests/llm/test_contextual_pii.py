"""Planted identifiers that no base pattern sees, by recall and precision, and patterns that only believed instances induce."""

import random

from linkloom.llm import pii

ASKED = {"phone": "you can reach my office by phone at", "card": "please charge my card number", "ip": "the server answers at address", "email": "write to the mailbox"}


def known(kind, r):
    if kind == "phone":
        return f"+1 ({r.randint(200, 999)}) 555-{r.randint(1000, 9999)}"
    if kind == "card":
        n = "4" + "".join(r.choice("0123456789") for _ in range(14))
        return next(n + d for d in "0123456789" if pii.luhn(n + d))
    if kind == "ip":
        return ".".join(str(r.randint(1, 250)) for _ in range(4))
    return f"name{r.randint(0, 10**6)}@mail{r.randint(0, 9)}.example.com"


def unseen(kind, r):
    if kind == "phone":
        return r.choice(["{} {} {}", "({}) {}-{}", "{}.{}.{}"]).format(r.randint(200, 999), r.randint(200, 999), r.randint(1000, 9999))
    if kind == "card":
        return "-".join(str(r.randint(1000, 9999)) for _ in range(5))  # too long for a card by its form
    if kind == "ip":
        return f"{r.randint(1, 250)}-{r.randint(1, 250)}-{r.randint(1, 250)}-{r.randint(10, 250)}"
    return f"name{r.randint(0, 10**6)}@localhost"


def noise(r, n):
    return " ".join(r.choice("of and river stone light under harbour walks slowly when morning comes over quiet hills".split()) for _ in range(n))


def table(seed=11, seeds=60, hidden=15, clean=200):
    r = random.Random(seed)
    rows, planted = [], {}
    for kind, asked in ASKED.items():
        for k in range(seeds + hidden):
            what = known(kind, r) if k < seeds else unseen(kind, r)
            before = f"{noise(r, r.randint(0, 8))} {asked} "
            rows.append((len(rows), f"{before}{what} thank you {noise(r, 5)}"))
            if k >= seeds:
                planted[len(rows) - 1] = what
    for _ in range(clean):
        rows.append((len(rows), f"{noise(r, 6)} invoice {r.randint(10**5, 10**9)} and {r.randint(100, 999)} {r.randint(1000, 9999)} boxes {noise(r, 4)}"))
    return rows, planted


def test_recall_and_precision_of_planted_identifiers(spark):
    rows, planted = table()
    text = dict(rows)
    got = pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    added = {(r.doc_id, text[r.doc_id][x.start : x.end], pii.KINDS[x.kind]) for r in got for x in r.added}
    kind_of = {d: list(ASKED)[d // 75] for d in planted}
    hit = {d for d, said, kind in added if d in planted and kind == kind_of[d] and said in planted[d] and len(said) >= len(planted[d]) - 6}
    assert len(hit) >= 0.9 * len(planted)
    assert len([x for x in added if x[0] in planted]) >= 0.9 * len(added)


def test_believed_instances_induce_patterns(spark):
    """A place with no seed of its own is learnt from instances that other places vouch for."""
    r = random.Random(2)
    numbers = [f"{r.randint(200, 999)} {r.randint(200, 999)} {r.randint(1000, 9999)}" for _ in range(30)]
    rows = [f"please call my phone {known('phone', r)} today" for _ in range(80)]
    rows += [f"please call my phone {n} today" for n in numbers[:25]]
    rows += [f"durchwahl lautet {n} ab morgen" for n in numbers]
    rows += [f"bestellung umfasst {r.randint(100, 999)} {r.randint(100, 999)} {r.randint(1000, 9999)} ab lager" for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {x.doc_id for x in pii.find_personal_data(docs).collect() if x.added}
    assert got == set(range(80, 135))


def test_secrets_by_their_names_and_places(spark):
    r = random.Random(3)
    key = lambda: "".join(r.choice("0123456789abcdef") for _ in range(40))
    rows = [f'words before token = "{key()}" and after' for _ in range(40)]
    rows += [f"a commit {key()} of yesterday" for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {x.doc_id: x for x in pii.digest(pii.find_personal_data(docs)).collect()}
    assert {d for d, x in got.items() if x.n_secret} == set(range(40)) and all(x.n_seeded == x.n_secret and x.n_added == 0 for x in got.values())
    assert got[0].spans == "secret:22:62" and got[0].n_email + got[0].n_ip + got[0].n_card + got[0].n_phone == 0


def plain_scores(found):
    """Confidence of each trusted (pattern, kind), by dictionaries."""
    seed, failed, near = {}, {}, {}
    for row in found:
        for x in row.base:
            for c in x.contexts:
                near.setdefault(c, set()).add(x.instance)
                seed.setdefault(c, {})[x.instance] = max(x.kind, seed.get(c, {}).get(x.instance, -1))
        for x in row.other:
            for c in x.contexts:
                near.setdefault(c, set()).add(x.instance)
                if x.seed is not None:
                    seed.setdefault(c, {})[x.instance] = max(x.seed, seed.get(c, {}).get(x.instance, -1))
                failed[c, x.instance] = failed.get((c, x.instance), False) or x.failed
    known = {(i, k): 1.0 for c in seed for i, k in seed[c].items()}
    belief = dict(known)
    for _ in range(pii.ROUNDS):
        kinds = {}
        for (i, k), b in belief.items():
            if b >= pii.MIN_CONFIDENCE:
                kinds.setdefault(i, set()).add(k)
        told = {}
        for c, members in near.items():
            for i in members:
                for k in kinds.get(i, ()):
                    told[c, k] = told.get((c, k), 0) + 1
        trusted = {}
        for (c, k), n in told.items():
            if n < pii.MIN_SEEDS:
                continue
            good = sum(belief.get((i, k), 0.0 if failed.get((c, i)) or i in seed.get(c, {}) else pii.PRIOR) for i in near[c])
            p, m, z = good / len(near[c]), len(near[c]), pii.SURE
            trusted[c, k] = (p + z * z / (2 * m) - z * (p * (1 - p) / m + z * z / (4 * m * m)) ** 0.5) / (1 + z * z / m)
        doubt = {}
        for (c, k), confidence in trusted.items():
            for i in near[c]:
                if i not in seed.get(c, {}) and not failed.get((c, i)):
                    doubt[i, k] = doubt.get((i, k), 1.0) * (1 - min(max(confidence, 0.0), 0.99))
        belief = {ik: 1 - d for ik, d in doubt.items()} | known
    return {ck: x for ck, x in trusted.items() if x >= pii.MIN_CONFIDENCE}


PLACES = {
    "phone": ["reach me by phone at", "telefon", "call the desk on"],
    "card": ["paid with card", "charge my card number", "kartennummer"],
    "ip": ["served from host", "the gateway is", "log in at"],
    "email": ["write to the mailbox", "contact", "schreiben an"],
}


def planted_copy(spark, seed=21, seeds=40, hidden=12):
    """All of `documents`, some with a sentence put between two of their words: known identifiers, and ones no base form has."""
    r = random.Random(seed)
    docs = [(x.doc_id, x.text or "") for x in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    planted = {}
    for kind, places in PLACES.items():
        for place in places:
            for k, at in enumerate(r.sample(range(len(docs)), seeds + hidden)):
                what = known(kind, r) if k < seeds else unseen(kind, r)
                doc, text = docs[at]
                words = text.split(" ")
                cut = r.randint(0, len(words))
                head = " ".join(words[:cut])
                said = f"{head} {place} {what} thanks"
                start = len(said) - len(what) - len(" thanks")
                if doc in planted:  # one a document, so that places stay as they are
                    continue
                docs[at] = (doc, f"{said} {' '.join(words[cut:])}")
                planted[doc] = (kind, start, start + len(what), k >= seeds)
    return docs, planted


def test_unseen_identifiers_of_a_planted_copy_of_the_documents(spark):
    docs, planted = planted_copy(spark)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(8)
    found = pii.find_personal_data(frame).collect()
    hidden = {d: x for d, x in planted.items() if x[3]}
    added = [(r.doc_id, pii.KINDS[x.kind], x.start, x.end) for r in found for x in r.added]
    hit = {d for d, kind, start, end in added if d in hidden and kind == hidden[d][0] and hidden[d][1] <= start < hidden[d][1] + 4 and hidden[d][2] - 4 < end <= hidden[d][2]}
    assert len(hidden) > 60 and len(hit) >= 0.9 * len(hidden), (len(hit), len(hidden))
    right = sum(d in hidden and start < hidden[d][2] and end > hidden[d][1] for d, _, start, end in added)
    assert right >= 0.9 * len(added), (right, len(added))


def test_scores_against_plain_recomputation(spark):
    docs, _ = planted_copy(spark, seed=5, seeds=12, hidden=6)
    found = pii.stored(pii.scan(spark.createDataFrame(docs, "doc_id long, text string").repartition(6)))
    got = {(r.context, r.kind): r.confidence for r in pii.score_patterns(found).collect()}
    want = plain_scores(found.collect())
    assert got.keys() == want.keys() and len(got) > 5
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got)
