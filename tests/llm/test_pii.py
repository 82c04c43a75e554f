import collections
import hashlib
import math
import re
import time

from knotwork.llm import pii
from knotwork.llm.pii import find_personal, personal_spans, sanitise

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def digits(m):
    return re.sub("[^0-9]", "", m)


def luhn(s):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(s))) % 10 == 0


KEEP = {"email": lambda m: True, "ip": lambda m: all(int(x) <= 255 for x in m.split(".")), "card": lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m)), "phone": lambda m: 10 <= len(digits(m)) <= 15}


def brute(text):
    spans = sorted((m.start(), k, m.end(), kind) for k, kind in enumerate(BASE) for m in re.finditer(BASE[kind], text or "") if KEEP[kind](m.group()))
    joined = ",".join(f"{kind}:{s}:{e}" for s, _, e, kind in spans)
    return (*(sum(x[3] == kind for x in spans) for kind in BASE), hashlib.sha256(joined.encode()).hexdigest()), joined


def key(r):
    return (r[0] is None, r[0] or 0, r[1:])


def check(docs):
    got = [tuple(r)[:6] for r in personal_spans(docs).collect()]
    want = [(r["doc_id"], *brute(r["text"])[0]) for r in docs.collect()]
    assert sorted(got, key=key) == sorted(want, key=key)


def test_odd_rows(spark, odd_docs, no_docs):
    check(odd_docs)
    assert personal_spans(no_docs).collect() == []


def test_hard_texts(spark):
    texts = ["a@b.c+d@e.f x@y@z.w", "a@b a@.c @x.y a@b..c a@b.c.", "1.2.3.4.5.6.7.8 1.2.3 256.1.1.1 0001.2.3.255 1.2.3.4000", "4111 1111 1111 1111, 4111-1111-1111-1111 4111  1111", "12 -34 4111111111111111 41111111111111112222", "5 4111111111111111", "+1 (234) 567-8901 +12 +1234567890123456 +1-2-3 ++1 234 567 890", "日本 é a@b.c 𝒳 1.2.3.4 𝒳𝒳 +1 234 567 8901.", "1" * 30_000, "a" * 30_000, "+1" * 5000, "1 " * 20_000, "1." * 20_000, "a@" * 10_000, "x" * 5000 + "@a.b"]
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def test_whole_table(spark, documents):
    check(documents)


def spans_by_brute_force(rows, alpha=0.9, support=2):
    """{(doc_id, text): spans} of rows (doc_id, text), by counting everything."""
    told, n = [], len(rows)
    for d, t in rows:
        base = [(m.start(), k, m.end(), m.group()) for k, kind in enumerate(BASE) for m in re.finditer(BASE[kind], t or "") if KEEP[kind](m.group())]
        masked = re.sub(BASE["email"], lambda m: " " * len(m.group()), t or "")
        found = [(m.start(), 4, m.end(), m.group().lower()) for m in re.finditer(r"[^\W\d_]{3,}", masked)]
        ents = {f"{k}:{re.sub('[ ().-]', '', m.lower())}" for _, k, _, m in base}
        told.append((d, t or "", base, found, ents, {w[3] for w in found}))
    ce, ct, both = collections.Counter(), collections.Counter(), collections.defaultdict(list)
    for _, t, _, _, ents, words in told:
        ce.update(ents)
        ct.update(words)
        for e in ents:
            for w in words:
                both[e, w].append(t)
    reveals = {w for (e, w), ts in both.items() if len(set(ts)) >= support and ce[e] < n and math.log2(len(ts) * n / (ce[e] * ct[w])) >= alpha * math.log2(n / ce[e]) - 1e-12}
    names = [*BASE, "term"]
    return {(d, t): ",".join(f"{names[k]}:{s}:{e}" for s, k, e, _ in sorted([*base, *[w for w in found if w[3] in reveals]])) for d, t, base, found, _, _ in told}


def revealing():
    """A name far from the address and in a text without it; words of several entities; common words."""
    gap = "and so on with many words between that are in each and every text of the lot, " * 4
    rows = [(i, f"Zanzibar wrote {gap} filler {i} to jo@ex.org and jo@ex.org") for i in range(6)]
    rows += [(50 + i, f"{gap} filler {i} the Quokka team at +1 (234) 567-890{i % 2} or 10.0.0.{i % 3}") for i in range(8)]
    rows += [(70, "Zanzibar stands here alone, no address by it"), (71, "quokka QUOKKA ÉQUOKKA ééa@b.cd/quokka@b.cd"), (71, "quokka QUOKKA ÉQUOKKA ééa@b.cd/quokka@b.cd"), (None, "Zanzibar again"), (72, None), (73, "")]
    return rows + [(100 + i, f"{gap} filler {i % 9} number {i}") for i in range(200)]


def test_words_that_reveal_wherever_they_stand(spark):
    rows = revealing()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = find_personal(df)
    got = {(r["doc_id"], r["h"]): r["spans"] for r in found.select("doc_id", "h", pii._joined(found["spans"]).alias("spans")).collect()}
    key = {(r["doc_id"], r["text"]): r["h"] for r in df.selectExpr("doc_id", "coalesce(text, '') text", "xxhash64(coalesce(text, '')) h").collect()}
    want = spans_by_brute_force(rows)
    assert got == {(d, key[d, t]): v for (d, t), v in want.items()}
    assert want[70, rows[14][1]].startswith("term:0:8") and "term" in want[0, rows[0][1]] and "term" not in want[100, rows[20][1]]
    clean = {r["doc_id"]: r["text"] for r in sanitise(df).collect()}
    assert clean[70].startswith("[TERM] stands") and "Zanzibar" not in clean[0] + clean[None] and clean[0].endswith("[EMAIL] and [EMAIL]")


def test_terms_of_the_table(spark, documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    want = spans_by_brute_force(rows)
    assert {r["doc_id"]: r["spans"] for r in personal_spans(documents).collect()} == {d: v for (d, _), v in want.items()}


def test_very_long_texts_in_linear_time(spark):
    """100,000 addresses, and as many of each other kind, in one text."""
    n = 100_000
    texts = [" ".join(f"a{i}@b{i}.cd" for i in range(n)), " ".join(f"10.{i % 200}.3.4" for i in range(n)), " ".join(f"+1 234 567 {i:05d};" for i in range(n)), "4111 1111 1111 1111, " * 20_000]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts * 2)], "doc_id long, text string")
    began = time.time()
    rows = {r["doc_id"]: r for r in personal_spans(df.where("doc_id < 4")).collect()}
    assert time.time() - began < 60
    assert [(rows[k]["n_email"], rows[k]["n_ip"], rows[k]["n_phone"]) for k in range(3)] == [(n, 0, 0), (0, n, 0), (0, 0, n)]
    for k, t in enumerate(texts):
        assert rows[k]["base_sha256"] == brute(t)[0][-1]


def test_overlapping_spans_become_one(spark):
    text = "𝒳 +378282246310005 x 4111 1111 1111 1111; 1.2.3.4111111111111111 a@b.cd"
    df = spark.createDataFrame([(1, text, "x")], "doc_id long, text string, __cuts string")
    assert sanitise(df).first()["text"] == "𝒳 [PHONE] x [CARD]; 1.2.3.[CARD] [EMAIL]" and sanitise(df).columns == df.columns


def test_sanitised_text_and_columns(spark, odd_docs):
    out = sanitise(odd_docs)
    assert out.columns == odd_docs.columns and out.count() == odd_docs.count()
    text = out.where("doc_id = 6").first()["text"]
    assert text == "Ünïcode wörds ÀÉ mail [EMAIL] and [PHONE] 日本"
    assert out.where("doc_id = 1").first()["text"] is None


def test_spans_hold_every_base_span(spark, documents):
    assert find_personal(documents).where("size(array_except(base, spans)) > 0").count() == 0
