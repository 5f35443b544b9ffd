import hashlib
import math
import re
from collections import Counter, defaultdict

from terramark.llm import pii

SCHEMA = "doc_id long, text string, base string"
KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum((x if i % 2 == 0 else x * 2 - 9 * (x > 4)) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def passes(kind, v):
    d = re.sub("[^0-9]", "", v)
    return {"email": True, "ip": all(int(p) <= 255 for p in v.split(".")) if kind == "ip" else True,
            "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]


def spans(text):
    return [(k, m.start(), m.end(), m[0]) for k, p in KINDS.items() for m in re.finditer(p, text or "") if passes(k, m[0])]


def terms_of(text):
    """Stripped, lower-cased words that begin with a letter or digit and hold nothing but these, ' and -."""
    out = set()
    for w in re.findall(r"[^\x20\x09-\x0D]+", text):
        w = re.sub(r"^[\W_]+|[\W_]+$", "", w).lower()
        if re.fullmatch(r"[^\W_](?:[^\W_]|['-])*", w):
            out.add(w)
    return out


def context(text, start, end, width=64):
    """The words wholly within `width` code points of a span: no word is taken that begins or ends beyond."""
    parts = []
    for lo, hi in ((max(0, start - width), start), (end, min(len(text), end + width))):
        for m in re.finditer(r"[^\x20\x09-\x0D]+", text[lo:hi]):
            cut_left = lo < start and lo > 0 and m.start() == 0 and hi == start and not text[lo - 1].isspace()
            cut_right = lo == end and lo + m.end() == hi < len(text) and not text[hi].isspace()
            if not cut_left and not cut_right:
                parts.append(m[0])
    return terms_of(" ".join(parts))


def brute_force(docs, prior=2, least=0.8):
    """{(doc_id, term)} of (doc_id, text): quasi identifiers, by counts over distinct texts."""
    texts = {(t or "") for _, t in docs}
    held = {(t or ""): spans(t) for i, t in docs if i is not None and spans(t)}
    having, n = Counter(w for t in texts for w in terms_of(t)), len(texts)
    owners, both = defaultdict(set), defaultdict(set)
    for t, found in held.items():
        for _, a, b, v in found:
            owners[v].add(t)
            for w in context(t, a, b):
                both[v, w].add(t)
    want = set()
    for (v, w), where in both.items():
        n_e = len(owners[v])
        if n_e < n and math.log(len(where) / (having[w] + prior) * n / n_e) / math.log(n / n_e) >= least - 1e-12:
            want |= {(i, w) for i, t in docs if i is not None and (t or "") in owners[v] and w in terms_of(t)}
    return want


TEXTS = [
    "mail a.b@c.de or x@y, a@b.c_d@e.f and 1.2.3.4.5.6.7.8 or 256.1.1.1 007.1.1.1",
    "card 4041 8949-7460 8795 4041894974608795 4111111111111111 4111 1111 1111 1112 12345678901234567890123",
    "call +1 (555) 123-4567. or +49 30 12 or +1 2", "é🙂 a@b.cd é +12.345.678.901)", None, "", "@@..++", "1" * 50_000,
    "a." * 20_000 + "@x", "1 2 " * 10_000, "a@" + "b." * 5_000 + "c", "x" * 100_000, "1-2--3 +", "4111111111111111@a.b 4111111111111111.",
]


def test_base_spans_match_the_patterns(spark):
    frame = spark.createDataFrame([(i, t, "z") for i, t in enumerate(TEXTS)], SCHEMA)
    got = {r.doc_id: r for r in pii.digest(pii.find_pii(frame)).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        want = spans(t)
        line = ",".join(f"{k}:{a}:{b}" for k, a, b, _ in want)
        counts = Counter(k for k, *_ in want)
        r = got[i]
        assert (r.spans, r.base_sha256) == (line, hashlib.sha256(line.encode()).hexdigest()), i
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(counts[k] for k in KINDS)
    assert pii.find_pii(frame.limit(0)).count() == 0


def test_base_spans_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r.base_sha256 for r in pii.digest(pii.find_pii(docs)).collect()}
    for r in docs.collect():
        line = ",".join(f"{k}:{a}:{b}" for k, a, b, _ in spans(r.text))
        assert got[r.doc_id] == hashlib.sha256(line.encode()).hexdigest()


def test_terms_match_brute_force(spark):
    fill = "common ordinary sentences without anything special whatever"
    texts = [f"{fill} contact ann@x.org about Zeppelinfabrik, please {i}" for i in range(4)]
    texts += [f"{fill} bob@y.org builds submarines {i}" for i in range(4)] + [f"{fill} submarines everywhere {i}" for i in range(9)]
    texts += [f"{fill} about {i}" for i in range(400)] + [None, "", ""]
    texts += ["Quirinus wrote to cat@z.org once"] * 3 + [f"far away Xanthippe {'word ' * 20}dog@z.org {'word ' * 20}Yggdrasil"]
    docs = list(enumerate(texts)) + [(None, "ann@x.org zeppelinfabrik")]
    want = brute_force(docs)
    found = pii.find_pii(spark.createDataFrame([(i, t, "z") for i, t in docs], SCHEMA))
    got = {(r.doc_id, r.text[s.start:s.end].lower()) for r in found.collect() for s in r.terms}
    assert got == want and (0, "zeppelinfabrik") in want and (4, "builds") in want and (4, "submarines") not in want
    one = texts.index("Quirinus wrote to cat@z.org once")
    assert {(one, "quirinus"), (one + 2, "quirinus")} <= want and not any(w in ("xanthippe", "yggdrasil") for _, w in want)
    clean = {r.doc_id: r.clean for r in pii.sanitised(found).collect()}
    assert clean[1] == f"{fill}  [email] about ,  1" and clean[20] == texts[20]


def test_terms_of_documents_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = pii.find_pii(docs)
    got = {(r.doc_id, r.text[s.start:s.end].lower()) for r in found.collect() for s in r.terms}
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    # A term that overlaps a base span gives no span of its own.
    base = {i: [(a, b) for _, a, b, _ in spans(t)] for i, t in rows}
    free = {(i, w) for i, w in brute_force(rows) for t in [dict(rows)[i]] for m in re.finditer(r"[^\x20\x09-\x0D]+", t)
            if terms_of(m[0]) == {w} and not any(m.start() < b and a < m.end() for a, b in base[i])}
    assert got == free and got


def test_planted_identifiers(spark):
    """Names beside addresses, each in one or two texts, among words that occur everywhere."""
    common = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    some = lambda seed, n: " ".join(common[(seed * 7919 + k * k * 31) % 200] for k in range(n))
    texts, planted = [some(i, 60) for i in range(1500)], set()
    for i in range(100):
        for j in range(1 + i % 2):
            planted.add((len(texts), f"surname{i}x"))
            texts.append(f"{some(i + j, 20)} Surname{i}x, user{i}@mail.org {some(2 * i + j, 20)}")
    found = pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = {(r.doc_id, r.text[s.start:s.end].lower()) for r in found.collect() for s in r.terms}
    assert len(got & planted) / len(planted) >= 0.95 and len(got & planted) / len(got) >= 0.95


def test_terms_of_several_entities_are_generalised(spark):
    texts = [f"ann@x.org +49 30 1234567 Zeppelin k4711 note {i}" for i in range(3)] + [f"note of nothing else {i}" for i in range(60)]
    found = pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), bounds=None)
    clean = {r.doc_id: r.clean for r in pii.sanitised(found).collect()}
    assert clean[0] == "[email] [phone] [name] [code] note 0" and clean[9] == texts[9]
    rows = {r.doc_id: r for r in pii.digest(found).collect()}
    assert (rows[0].terms_generalised, rows[0].terms_removed) == (2, 0)
    assert rows[0].clean_sha256 == hashlib.sha256(clean[0].encode()).hexdigest()


def test_a_list_of_thousands_of_entities(spark):
    """A list in three copies: all its words are quasi identifiers of all its entities."""
    n = 1500
    entry = " ".join(f"name{i} user{i}@list.org" for i in range(n))
    texts = [f"{entry} {i}" for i in range(3)] + [f"plain words {i}" for i in range(40)]
    rows = {r.doc_id: r for r in pii.digest(pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), bounds=None)).collect()}
    assert len(rows) == 43
    assert all((rows[i].n_email, rows[i].terms_generalised) == (n, n) for i in range(3)) and rows[5].spans == ""
