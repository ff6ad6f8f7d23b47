"""Operator 5: secret scans, in DataFrame and SQL expressions throughout.

Patterns find candidates; a random forest removes false positives. It sees a
candidate's length, its shares of character kinds and the transitions between
them, how much of it a dictionary covers, whether it is part of a path, and the
words around it. It is trained on labelled findings made from rules with a fixed
seed, and its trees become one SQL expression.

A scan is a projection of each row: no shuffle, no explode, no Python.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from searchloom.llm.textcore import worker_cache

TREES, DEPTH, THRESHOLD = 24, 7, 0.5
#: Candidates of a text whose lengths are summed at once.
GROUP = 256
MASK = "[SECRET]"

#: Key words, signs, block and long-token patterns (Java syntax; \x22 and \x27 are the quotes).
KEY_WORDS = r"(?:password|passwd|pwd|secret|token|api[_\-]?key|access[_\-]?key|private[_\-]?key|auth)"
LEAD = KEY_WORDS + r"[A-Za-z0-9_]{0,16}[\x22\x27]?\s{0,3}(?:=>|=|:)\s{0,3}[\x22\x27]?"
KEYED = r"(?i:" + LEAD + r")(?!-----BEGIN)[^\s\x22\x27<>]{8,}+"
BLOCK = r"-----BEGIN [A-Z0-9 ]{0,30}PRIVATE KEY(?: BLOCK)?-----[^-]++(?:-{1,4}[^-]++)*+-----END [A-Z0-9 ]{0,30}PRIVATE KEY(?: BLOCK)?-----"
LONG = r"(?<![A-Za-z0-9+/=_\-])(?=[A-Za-z+/=_\-]*+[0-9])[A-Za-z0-9+/=_\-]{16,}+(?:\.[A-Za-z0-9_\-]{10,}+){0,2}"
CANDIDATE = BLOCK + "|" + KEYED + "|" + LONG
KNOWN = r"^(?:AKIA|ASIA|gh[opsu]_|github_pat_|glpat-|sk_live_|sk-|rk_live_|xox[abprs]-|AIza|eyJ|npm_|-----BEGIN)"
TELLING = r"secret|token|passw|pwd|api.?key|access.?key|private.?key|credential|bearer|auth"
OTHERWISE = r"sha-?\d|md5|commit|checksum|digest|hash|uuid|guid|isbn|order|invoice|phone|card|account|example|sample|dummy|placeholder|revision|build|version|base64,"
DICTIONARY = (
    "the|and|for|that|with|this|from|have|your|here|test|example|sample|dummy|placeholder|change|password|secret|token|key|user|name|value|data|file|"
    "image|page|index|config|server|client|local|host|http|www|com|org|net|html|json|photo|document|report|number|order|item|version|release|build|"
    "main|master|branch|date|time|year|month|day|node|module|class|function|string|object|type|null|none|true|false|admin|root|home|path|var|usr|lib|src"
)

#: Features of v (the whole value; only its length counts up to 200), before and after, in order.
FEATURES = {
    "n": "least(length(x.v), 200)",
    "digits": r"1 - length(regexp_replace(x.v, r'[0-9]', '')) / length(x.v)",
    "upper": r"1 - length(regexp_replace(x.v, r'[A-Z]', '')) / length(x.v)",
    "lower": r"1 - length(regexp_replace(x.v, r'[a-z]', '')) / length(x.v)",
    "symbols": r"length(regexp_replace(x.v, r'[A-Za-z0-9]', '')) / length(x.v)",
    "hex": r"CAST(x.v RLIKE r'^(?:[0-9a-f]+|[0-9A-F]+)$' AS INT)",
    "turns": r"(size(split(x.v, r'(?<=[0-9])(?=[^0-9])|(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[^A-Za-z0-9])(?=[A-Za-z0-9])')) - 1) / length(x.v)",
    "distinct": "size(array_distinct(split(x.v, ''))) / least(length(x.v), 200)",
    "covered": f"1 - length(regexp_replace(lower(x.v), r'{DICTIONARY}', '')) / length(x.v)",
    "path": r"CAST(x.v RLIKE r'/[^/]+/|\.(?:html?|png|jpe?g|js|css|py|md|txt)$' OR x.before RLIKE r'(?:[/.\\]|://\S*)$' AS INT)",
    "telling": f"CAST(x.before RLIKE r'(?:{TELLING})' AS INT)",
    "assigned": r"CAST(x.before RLIKE r'[=:]\s{0,3}[\x22\x27]?$' AS INT)",
    "quoted": r"CAST(x.before RLIKE r'[\x22\x27]$' AND x.after RLIKE r'^[\x22\x27]' AS INT)",
    "otherwise": f"CAST(x.before RLIKE r'(?:{OTHERWISE})' OR x.after RLIKE r'^\\W{{0,3}}(?:{OTHERWISE})' AS INT)",
    "known": f"CAST(x.v RLIKE r'{KNOWN}' AS INT)",
    "number": r"CAST(x.v RLIKE r'^[0-9\-_./]+$' AS INT)",
    "grouped": r"CAST(x.v RLIKE r'^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$' OR x.v RLIKE r'(?:19|20)[0-9]{2}[-_/]?[0-1][0-9][-_/]?[0-3][0-9]' AS INT)",
    "blank": r"CAST(x.v RLIKE r'^[$%{<*]|(?i)(?:x{4}|your_|changeme|0{6}|\*{4}|\.\.\.)' AS INT)",
}


def _found(text: str) -> str:
    """SQL for the candidates in the columns __m (matches) and __p (what is
    between them): match, value, and up to 48 and 24 characters around it."""
    lead = f"regexp_extract(m, r'^(?i:{LEAD})', 0)"
    return f"""transform(__m, (m, i) -> named_struct('m', m, 'v', if(m RLIKE r'^(?i:{LEAD})', substring(m, length({lead}) + 1), m),
        'before', lower(concat(right(__p[i], 48), if(m RLIKE r'^(?i:{LEAD})', {lead}, ''))), 'after', lower(left(__p[i + 1], 24)),
        'rule', CASE WHEN m LIKE '-----BEGIN%' THEN 'block' WHEN m RLIKE r'^(?i:{LEAD})' THEN 'keyed' ELSE 'long' END))"""


def _features_sql(found: str) -> str:
    return f"transform({found}, x -> named_struct('v', x.v, {', '.join(f"'{k}', CAST({v} AS DOUBLE)" for k, v in FEATURES.items())}))"


def labelled_findings(spark: SparkSession, n: int = 6000) -> DataFrame:
    """n made findings (text, label): secrets in the forms that leak, and what
    resembles them. Row i is of form i modulo the number of forms; all else
    comes from a hash of i."""
    h = lambda k: f"sha2(concat('{k}', id), 256)"
    b64 = lambda k: f"translate(base64(unhex({h(k)})), '=', '')"
    num = lambda k, m: f"pmod(xxhash64('{k}', id), {m})"
    pick = lambda k, *xs: f"element_at(array({', '.join(repr(x) for x in xs)}), CAST({num(k, len(xs))} AS INT) + 1)"
    word = lambda k: pick(k, "in the end", "of these things", "la maison est", "und der weg", "para los dos", "was read as", "then came", "it said")
    key = pick("k", "token", "secret", "api_key", "password", "access_key", "auth_token", "API-KEY", "client_secret", "private_key")
    sign = pick("s", " = ", "=", ": ", " : ", " => ")
    q = pick("q", '"', "'", "", '"')
    digits = lambda k, m: f"substring(translate({h(k)}, 'abcdef', '394817'), 1, {m})"
    put = lambda v: f"concat({word('a')}, ' ', {key}, {sign}, {q}, {v}, {q}, ' ', {word('b')})"
    bare = lambda v: f"concat({word('a')}, ' ', {v}, ' ', {word('b')})"
    told = lambda t, v: f"concat({word('a')}, ' ', {t}, {v}, ' ', {word('b')})"
    secret = [
        put(f"substring({h('1')}, 1, 40)"), put(f"substring({h('2')}, 1, 40)"), put(f"substring({h('3')}, 1, 32)"), put(h("4")), put(b64("5")), put(f"substring({b64('6')}, 1, 24)"),
        put(f"concat('AKIA', substring(upper({b64('7')}), 1, 16))"), bare(f"concat('AKIA', upper(substring({h('8')}, 1, 16)))"), bare(f"concat('ghp_', substring(translate({b64('9')}, '+/', 'ab'), 1, 36))"),
        bare(f"concat('sk_live_', substring(translate({b64('10')}, '+/', 'ab'), 1, 24))"), bare(f"concat('xoxb-', {digits('11', 12)}, '-', substring(translate({b64('12')}, '+/', 'ab'), 1, 24))"),
        bare(f"concat('eyJ', translate({b64('13')}, '+/', '-_'), '.eyJ', translate({b64('14')}, '+/', '-_'), '.', translate({b64('15')}, '+/', '-_'))"),
        put(f"concat(substring({b64('16')}, 1, 7), '!', substring({h('17')}, 1, 4))"), put(f"substring({b64('18')}, 1, 12)"),
        f"concat('-----BEGIN RSA PRIVATE KEY-----\\n', {b64('19')}, {b64('20')}, '\\n-----END RSA PRIVATE KEY-----')",
        told(pick("t", "the secret key is ", "use token ", "credentials ", "bearer "), b64("21")),
    ]
    other = [
        bare(digits("31", 16)), bare(digits("32", 16)), bare(f"upper(substring({h('33')}, 1, 40))"), bare(f"substring({h('34')}, 1, 40)"), told(pick("t", "commit ", "sha1 ", "checksum: ", "md5: ", "digest ", "hash "), f"substring({h('35')}, 1, 40)"),
        told(pick("t", "sha256: ", "sha-256 ", "hash="), h("36")), bare(f"concat(substring({h('37')}, 1, 8), '-', substring({h('37')}, 9, 4), '-', substring({h('37')}, 13, 4), '-', substring({h('37')}, 17, 4), '-', substring({h('37')}, 21, 12))"),
        told("'id: '", f"concat(substring({h('38')}, 1, 8), '-', substring({h('38')}, 9, 4), '-', substring({h('38')}, 13, 4), '-', substring({h('38')}, 17, 4), '-', substring({h('38')}, 21, 12))"),
        told("'https://www.example.com/images/'", f"concat('photo_', {digits('39', 8)}, '_large/', {digits('40', 6)}, '/page-', {digits('41', 4)})"), bare(f"concat('IMG_2024', {digits('42', 4)}, '_', {digits('43', 6)}, '-report')"),
        told("'order number: '", digits("44", 18)), told(pick("t", "phone: ", "account ", "isbn: ", "invoice-"), digits("45", 17)), bare(f"concat('2024-0', 1 + {num('46', 9)}, '-1', {num('47', 9)}, '_release-build-', {digits('48', 3)})"),
        f"concat({word('a')}, ' ', {key}, {sign}, {q}, {pick('p', 'YOUR_API_KEY_HERE_1', 'example-token-placeholder', '${SECRET_TOKEN_1}', 'xxxxxxxxxxxx1234', 'changeme_password', '<your_secret_1>', '********1234', 'your_token_here_2')}, {q})",
        told("'data:image/png;base64,'", b64("49")), f"concat({word('a')}, ' ', {key}, ': ', {pick('w', 'generation', 'remembered', 'forgotten,', 'considered', 'management', 'revolution', 'handling.')}, ' ', {word('b')})",
    ]
    forms = secret + other
    rows = spark.range(0, n, 1, 4)
    text = f"CASE {' '.join(f'WHEN id % {len(forms)} = {i} THEN {x}' for i, x in enumerate(forms))} END"
    return rows.select(F.expr(text).alias("text"), (F.col("id") % len(forms) < len(secret)).cast("double").alias("label"))


def _tree_sql(lines: list[str]) -> str:
    """A tree of a model's description as nested CASE expressions over f."""
    line = lines.pop(0).strip()
    if line.startswith("Predict:"):
        return line.split(":")[1].strip()
    m = re.match(r"If \(feature (\d+) <= (\S+)\)", line)
    low = _tree_sql(lines)
    lines.pop(0)
    high = _tree_sql(lines)
    return f"CASE WHEN f.{list(FEATURES)[int(m[1])]} <= {float(m[2])!r}D THEN {low} ELSE {high} END"


def train_forest(spark: SparkSession):
    """(model, data): the forest and the labelled findings' features it was trained on."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = _candidates(labelled_findings(spark), "text").select("label", F.expr(_features_sql(_found("text"))).alias("fs"))
    flat = rows.where("size(fs) > 0").select("label", F.col("fs")[0].alias("f")).select("label", "f.*").drop("v")
    data = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(flat)
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=5, maxBins=64).fit(data.select("label", "features")), data


def trees_sql(model) -> str:
    """The share of a forest's trees that call the finding with features f a secret."""
    trees = re.split(r"\n\s*Tree \d+ \(weight [\d.]+\):\n", model.toDebugString)[1:]
    return "(" + " + ".join(_tree_sql(t.rstrip().split("\n")) for t in trees) + f") / {len(trees)}D"


def forest_sql(spark: SparkSession) -> str:
    """trees_sql of the trained forest, trained once a process."""
    return worker_cache(("forest", TREES, DEPTH), lambda: trees_sql(train_forest(spark)[0]))


def _candidates(df: DataFrame, text: str) -> DataFrame:
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return df.withColumn("__m", F.regexp_extract_all(t, F.lit(CANDIDATE), F.lit(0))).withColumn("__p", F.split(t, CANDIDATE, -1))


def scan(df: DataFrame, text: str = "text", keep: list[str] | None = None, forest: str | None = None) -> DataFrame:
    """The columns named in keep, redacted (the text with each secret's value
    replaced by MASK; a null text stays null) and findings, an array of (start,
    n_chars, rule, value, score) of the kept ones in order; start counts
    characters from 0.

    Texts are scanned whole. Null, empty and clean texts have no finding; rows
    are independent, so repeated rows and keys don't matter, and findings don't
    tie, as they don't overlap. An empty table gives no rows. keep may name columns
    of any names; one named redacted or findings gives way to the result's.

    Candidates are key blocks of any kind, headers included; at least 8 characters
    behind a key word and a sign; and elsewhere at least 16 characters with a digit.
    So a password below 8 characters, and a bare token below 16 or of letters
    alone, which words and names can't be told from, are never found.
    """
    keep = [c for c in keep or ["doc_id"] if c not in ("redacted", "findings")]
    forest = forest or forest_sql(df.sparkSession)
    base = df.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("__rest"), F.col(text).cast("string").alias("__t"))
    rows = _candidates(base, "__t").withColumn("__x", F.expr(_found("__t")))
    rows = rows.withColumn("__s", F.expr(f"transform({_features_sql('__x')}, f -> {forest})"))
    # the characters up to a candidate: those of whole groups of GROUP, then of its own group
    rows = rows.withColumn("__n", F.expr("transform(__p, (p, j) -> CAST(length(p) + if(j < size(__m), length(__m[j]), 0) AS LONG))"))
    rows = rows.withColumn("__g", F.expr(f"transform(sequence(0, (size(__n) - 1) div {GROUP}), g -> aggregate(slice(__n, CAST(g AS INT) * {GROUP} + 1, {GROUP}), 0L, (a, n) -> a + n))"))
    rows = rows.withColumn("__h", F.expr("transform(__g, (n, g) -> aggregate(slice(__g, 1, g), 0L, (a, m) -> a + m))"))
    start = f"__h[CAST(i div {GROUP} AS INT)] + aggregate(slice(__n, CAST(i div {GROUP} AS INT) * {GROUP} + 1, i % {GROUP}), 0L, (a, n) -> a + n) + length(__p[i]) + length(x.m) - length(x.v)"
    found = f"""filter(transform(__x, (x, i) -> if(__s[i] >= {THRESHOLD}, named_struct('start', {start}, 'n_chars', CAST(length(x.v) AS LONG), 'rule', x.rule, 'value', x.v, 'score', round(__s[i], 6)), null)), x -> x IS NOT NULL)"""
    masked = f"""if(__t IS NULL, null, array_join(transform(__p, (p, i) -> concat(p, if(i < size(__x), if(__s[i] >= {THRESHOLD}, concat(left(__x[i].m, length(__x[i].m) - length(__x[i].v)), '{MASK}'), __x[i].m), ''))), ''))"""
    return rows.select("__rest.*", F.expr(masked).alias("redacted"), F.expr(found).alias("findings"))
