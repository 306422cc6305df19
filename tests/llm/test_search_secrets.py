"""Exact search and secret scans."""

import base64
import hashlib
import json

import numpy as np

from seriloom.llm import catalog, mtree, secrets
from tests.llm import brute
from tests.llm.conftest import SF


def plain_top(vectors, k):
    """{(query, rank): (id, score)} by all products."""
    ids = np.array(sorted(vectors))
    table = np.array([vectors[i] for i in ids])
    out = {}
    for i in ids[ids % 20 == 0]:
        scores = table @ np.array(vectors[i])
        order = [j for j in np.lexsort((ids, -scores)) if ids[j] != i][:k]
        out |= {(int(i), r + 1): (int(ids[j]), int(scores[j])) for r, j in enumerate(order)}
    return out


def test_query_equals_all_products(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    vectors = {r.vec_id: np.floor(64 * np.array(r.embedding, float)).astype(int) for r in rows}
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in catalog.QUERIES["op6_mtree_search"](spark, SF).collect()}
    assert got == plain_top(vectors, 20)


def test_copies_shards_and_pivots(spark):
    rng = np.random.default_rng(2)
    vectors = {i: rng.integers(-40, 40, 8).tolist() for i in range(600)}
    for i in range(200, 400):
        vectors[i] = vectors[7]  # a third of the rows is one vector
    table = spark.createDataFrame(list(vectors.items()), "id long, v array<long>")
    queries = table.filter("id % 20 = 0")
    for options in ({}, {"page": 4, "shard_rows": 50}):
        old, mtree.ROWS_PER_PIVOT = mtree.ROWS_PER_PIVOT, 60
        try:
            got = {(r.query_id, r["rank"]): (r.id, r.score) for r in mtree.top_k(table, queries, 5, **options).collect()}
        finally:
            mtree.ROWS_PER_PIVOT = old
        assert got == plain_top(vectors, 5)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, 1.0]), (20, [1.0, 1.0]), (20, [1.0, 1.0]), (1, None), (2, [nan, 1.0]), (3, [inf, 1.0]), (4, [None, 1.0]), (None, [1.0, 1.0]), (40, []), (60, [1.0, 2.0, 3.0]), (5, [-0.01, 0.0])]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, v string, id int")
    vectors = mtree.integer_vectors(table, "vec_id", "embedding")
    assert {(r.id, tuple(r.v)) for r in vectors.collect()} == {(0, (32, 64)), (20, (64, 64)), (40, ()), (60, (64, 128, 192)), (5, (-1, 0))}
    got = {(r.query_id, r["rank"]): (r.id, r.score) for r in mtree.top_k(vectors, vectors.filter("id % 20 = 0"), 3).collect()}
    assert got == {(0, 1): (20, 6144), (0, 2): (5, -32), (20, 1): (0, 6144), (20, 2): (5, -64)}
    assert mtree.top_k(vectors.filter("false"), vectors.filter("false")).collect() == []


def test_search_avoids_most_pages():
    rng = np.random.default_rng(3)
    centres = rng.integers(-200, 200, (20, 16))
    v = np.repeat(centres, 200, axis=0) + rng.integers(-5, 6, (4000, 16))
    greatest = float((v * v).sum(axis=1).max())
    tree = mtree.build_tree(mtree.augmented(v, greatest), 32)
    assert sorted(tree["entry"].tolist()) == list(range(4000)) and tree["count"].max() <= 32
    visited = []
    got = mtree.search_tree(tree, greatest, v, np.arange(4000), v[5], 5, 10, float("inf"), visited)
    scores = v @ v[5]
    order = [j for j in np.lexsort((np.arange(4000), -scores)) if j != 5][:10]
    assert got == [(int(scores[j]), int(j)) for j in order]
    assert len(visited) < len(tree["radius"]) / 2
    # radii and distances from parents hold for every node
    points = mtree.augmented(v, greatest)
    for n in range(len(tree["radius"])):
        if tree["leaf"][n]:
            own = tree["entry"][tree["first"][n] : tree["first"][n] + tree["count"][n]]
            assert (np.sqrt(((points[own] - tree["centre"][n]) ** 2).sum(axis=1)) <= tree["radius"][n] + 1e-9).all()


def test_secret_query(spark, documents):
    for r in catalog.QUERIES["op7_secrets"](spark, SF).collect():
        expected = brute.base_secrets(documents[r.doc_id])
        counts = [sum(k == kind for k, _, _ in expected) for kind in ("assign", "access", "hex")]
        assert [r.n_assign, r.n_access, r.n_hex] == counts
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in expected)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))


def der(tag, content):
    size = len(content)
    length = bytes([size]) if size < 128 else bytes([0x81, size]) if size < 256 else bytes([0x82, size >> 8, size & 255])
    return bytes([tag]) + length + content


KEY = der(0x30, der(2, b"\x00") + der(2, bytes(range(1, 130))) + der(2, b"\x01\x00\x01"))
SSH = b"".join(len(x).to_bytes(4, "big") + x for x in (b"ssh-ed25519", bytes(range(32))))


def b64(data):
    return base64.b64encode(data).decode()


def url64(value):
    return base64.urlsafe_b64encode(json.dumps(value).encode()).decode().rstrip("=")


def test_structures_are_confirmed():
    token = f"{url64({'alg': 'HS256', 'typ': 'JWT'})}.{url64({'sub': '1'})}.c2lnbmF0dXJl"
    text = f"é {b64(KEY)} then {b64(SSH)} and {token}. {KEY.hex()} end"
    found = secrets.in_order(secrets.confirmed_spans(text))
    assert [k for k, _, _ in found] == ["der", "ssh", "token", "der"]
    assert [text[a:b] for _, a, b in found] == [b64(KEY), b64(SSH), token, KEY.hex()]
    armour = f"-----BEGIN RSA PRIVATE KEY-----\n{b64(KEY)[:40]}\n{b64(KEY)[40:]}\n-----END RSA PRIVATE KEY-----"
    assert ("pem", 0, len(armour)) in list(secrets.confirmed_spans(armour))


def test_other_encodings_are_confirmed():
    odd_key = der(0x30, der(2, b"\x00") + der(2, b"\xfb\xef\xbe\xff" * 40))
    letters = base64.urlsafe_b64encode(odd_key).decode()
    assert "-" in letters or "_" in letters
    assert [(k, letters[a - 4 : b - 4]) for k, a, b in secrets.confirmed_spans(f"key {letters} end")] == [("der", letters)]
    assert [k for k, _, _ in secrets.confirmed_spans(f"x {SSH.hex()} y")] == ["ssh"]

    in_json = "-----BEGIN PRIVATE KEY-----\\n" + b64(KEY)[:40] + "\\n" + b64(KEY)[40:] + "\\n-----END PRIVATE KEY-----\\n"
    assert ("pem", 0, in_json.index("-----\\n", 40) + 5) in list(secrets.confirmed_spans(in_json))

    def locked(body, head="Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,000102030405060708090A0B0C0D0E0F\n\n"):
        return f"-----BEGIN RSA PRIVATE KEY-----\n{head}{b64(body)}\n-----END RSA PRIVATE KEY-----"

    whole, part = locked(bytes(range(7, 55))), locked(bytes(range(7, 54)))
    assert list(secrets.confirmed_spans(whole)) == [("pem", 0, len(whole))]
    assert list(secrets.confirmed_spans(part)) == []  # no whole blocks
    assert list(secrets.confirmed_spans(locked(bytes(range(7, 55)), "Comment: x-y\n\n"))) == []  # no cipher is named
    assert list(secrets.confirmed_spans("M" + "-a_b" * 2000 + " " + "-----BEGIN PRIVATE KEY-----" * 2000)) == []


def test_look_alikes_are_not():
    broken = KEY[:4] + bytes([KEY[4] ^ 0x41]) + KEY[5:]  # a length inside
    for data in (broken, KEY[:-1], KEY + b"\x00", bytes(100)):
        assert not secrets.is_der_key(data)
    assert not secrets.is_ssh_key(SSH[:-1]) and not secrets.is_ssh_key(b"")
    for text in (b64(bytes(range(60))), "eyJhbGciOiJ.x.y", f"{url64({'typ': 'x'})}.{url64({})}.a", "A" * 5000, "-----BEGIN PRIVATE KEY-----\nAAAA\n-----END PRIVATE KEY-----"):
        assert list(secrets.confirmed_spans(text)) == []
    assert secrets.der_parts(b"\x30\x80\x00\x00") is None  # no definite length
    deep = b"\x05\x00"
    for _ in range(40):
        deep = der(0x30, deep)
    assert secrets.der_parts(deep) is None


def test_base_patterns():
    text = "Password = 'abcdefghijkl' secret=token: abcdefghijklmnop API_KEY:xyz AKIAABCDEFGHIJKLMN1 deadbeefdeadbeef0 paſſword=abcdefghijklmnop"
    got = [(k, text[a:b]) for k, a, b in secrets.in_order(secrets.base_spans(text))]
    assert got == [(k, text[a:b]) for k, a, b in brute.base_secrets(text)]
    assert ("assign", "Password = 'abcdefghijkl") in got and ("hex", "deadbeefdeadbeef0") in got


def test_odd_rows(odd, odd_rows, none):
    rows = secrets.report(secrets.scan(odd)).collect()
    assert len(rows) == len(odd_rows) and all(r.spans == "" for r in rows)
    assert secrets.report(secrets.scan(none)).collect() == []
    same = secrets.redact(odd)
    assert same.columns == odd.columns and sorted(map(repr, same.collect())) == sorted(map(repr, odd.collect()))


def test_redaction():
    text = "a token=abcdefabcdefabcdef012345 b"
    spans = list(secrets.base_spans(text))
    assert {k for k, *_ in spans} == {"assign", "hex"}
    assert secrets.cover(text, spans, "[x]") == "a [x] b"
