"""Secrets of any length are found, hashed and masked whole."""

import hashlib

from searchloom.llm import secrets


def made(n, seed):
    out, i = "", 0
    while len(out) < n:
        out += hashlib.sha256(f"{seed}-{i}".encode()).hexdigest()[:40] + "QzRk"
        i += 1
    return out[:n]


def test_long_values_and_blocks_are_whole(spark):
    key = made(600, "key")
    body = "\n".join(made(64, i) for i in range(180))
    pem = f"-----BEGIN RSA PRIVATE KEY-----\n{body}\n-----END RSA PRIVATE KEY-----"
    short = f"-----BEGIN PRIVATE KEY-----\n{made(64, 'a')}\n-----END PRIVATE KEY-----"
    assert len(pem) > 8100
    want = {
        1: ('an api token = "{}" in a file', key, "keyed"),
        2: ("before\n{}\nafter", pem, "block"),
        3: ('private_key = "{}" and more', pem, "block"),
        4: ("private_key={} and more", short, "block"),
        5: ('"private_key": "{}", "next": 1', short.replace("\n", "\\n"), "block"),
    }
    df = spark.createDataFrame([(k, form.format(value)) for k, (form, value, _) in want.items()], "doc_id long, text string")
    got = {r.doc_id: r for r in secrets.scan(df).collect()}
    for k, (form, value, rule) in want.items():
        assert [(f.value, f.rule, f.start, f.n_chars) for f in got[k].findings] == [(value, rule, form.index("{}"), len(value))], k
        assert got[k].redacted == form.format("[SECRET]"), k
