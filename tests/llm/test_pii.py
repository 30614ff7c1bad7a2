import hashlib
import re

from stratagrid.llm import pii
from stratagrid.session import table

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(s):
    d = [int(c) for c in re.sub("[^0-9]", "", s)][::-1]
    return 14 <= len(d) <= 19 and sum(x if i % 2 == 0 else (2 * x - 9 * (x > 4)) for i, x in enumerate(d)) % 10 == 0


def good(kind, s):
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        return luhn(s)
    return kind == "email" or 10 <= len(re.sub("[^0-9]", "", s)) <= 15


def brute(text):
    found = []
    for i, (kind, p) in enumerate(BASE.items()):
        if {"email": "@", "ip": ".", "phone": "+"}.get(kind, "") not in (text or ""):
            continue  # no match without it; looking for one takes the square of a long run
        found += [(m.start(), i, kind, m.end()) for m in re.finditer(p, text or "", re.ASCII) if good(kind, m[0])]
    found.sort()
    said = ",".join(f"{k}:{s}:{e}" for s, _, k, e in found)
    return [sum(f[2] == k for f in found) for k in BASE], hashlib.sha256(said.encode()).hexdigest(), said


def check(docs):
    got = sorted(((r.doc_id is None, r.doc_id or 0, [r.n_email, r.n_ip, r.n_card, r.n_phone], r.base_sha256) for r in pii.find(docs).collect()))
    want = sorted(((r.doc_id is None, r.doc_id or 0, *brute(r.text)[:2]) for r in docs.select("doc_id", "text").collect()))
    assert got == want


def test_base_equals_brute_force(spark, sf):
    check(table(spark, sf, "documents"))


def test_odd_rows(odd):
    check(odd)


def test_empty_table(empty):
    assert pii.find(empty).count() == 0


TRICKY = [
    "1.2.3.4.5.6.7.8 and 999.1.1.1 and 001.02.3.255 then 1.2.3.4.",
    "4111 1111 1111 1111 x 4111-1111-1111-1112 y 41111111111111111111111 z 4111  1111 1111 1111",
    "+1 (555) 010-9999, +49.30.123456, ++15550109999+15550109999 +1",
    "a@b.co_x@y.org,b@c..d@e.f.g-h a.b+c@d-e.f 😀 é@x.y ü1@q.rs",
    "a@b.c_d@e.f%g@h.i@j.k aaa@bbb@ccc.com .x@y.z..w@v.u " + "q" * 4_000 + " @",
    "378282246310005 6011 0009 9013 9424 30569309025904-",
    "0" * 16,
]


def test_tricky_texts(spark):
    check(spark.createDataFrame(list(enumerate(TRICKY)), "doc_id long, text string"))


def test_added_kinds(spark):
    texts = ["My IBAN is GB82 WEST 1234 5698 7654 32.", "IBAN GB82WEST12345698765433", "social security 078-05-1120", "part 078-05-1120 fits"]
    rows = {r.doc_id: r for r in pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert rows[0].spans == "iban:11:38" and rows[1].n_iban == 0
    assert rows[2].n_ssn == 1 and rows[3].n_ssn == 0
    assert all(r.base_sha256 == hashlib.sha256(b"").hexdigest() for r in rows.values())


GB, DE = "GB82WEST12345698765432", "DE89370400440532013000"
FOLLOWED = {
    f"{GB} Please pay": [(0, 22)],
    f"{DE} BIC COBADEFF": [(0, 22)],
    f"{DE} 2024 due": [(0, 22)],
    "to DE89 3704 0044 0532 0130 00 BIC COBADEFF": [(3, 30)],
    f"\U0001f600 {DE} {GB} A": [(2, 24), (25, 47)],
    f"XX12 3456 {DE} {GB}, {GB}": [(10, 32), (33, 55), (57, 79)],
    f"{DE}4 and {DE}x": [],
    f"{DE} " * 3: [(0, 22), (23, 45), (46, 68)],
    "NO93 8601 1117 947 X": [(0, 18)],
}


def test_accounts_end_where_the_number_ends(spark):
    texts = list(FOLLOWED)
    rows = {r.doc_id: r for r in pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    want = {t: ",".join(f"iban:{a}:{b}" for a, b in v) for t, v in FOLLOWED.items()}
    assert {t: ",".join(s for s in rows[i].spans.split(",") if s.startswith("iban")) for i, t in enumerate(texts)} == want


def test_accounts_of_unlisted_countries(spark):
    body = "12345678901234"
    check = 98 - int(body + "3535" + "00") % 97
    number = f"ZZ{check:02d}{body}"
    grouped = " ".join(number[i : i + 4] for i in range(0, len(number), 4))
    texts = [f"{number} Please", f"{grouped} BIC COBADEFF", f"{number}."]
    got = [r.spans.split(",") for r in pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert [[s for s in g if s.startswith("iban")] for g in got] == [["iban:0:18"], [f"iban:0:{len(grouped)}"], ["iban:0:18"]]
