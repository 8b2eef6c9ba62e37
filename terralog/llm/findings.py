"""Labelled findings for the secret scan: candidates planted in written contexts, some of them held out.

Each template says what stands before and after a value, of what kind the value is, and whether it is a secret there. The
same kinds of values, and the same words beside them, occur as secrets and as something else, so neither tells the label.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Values of each template, and templates that are held out of training.
VALUES = 60
WORDS = "river stone market window silver garden summer bridge paper copper winter signal orange harbor forest candle".split()

# Is it a secret, the kind of value, the text before it and the text after it; {w} is a word.
TRAINING = [
    (1, "hex40", 'the {w} token = "', '" was in'), (1, "hex32", "api_key: ", "\n{w}"), (1, "hex64", "SECRET_KEY={w}", " "), (1, "b64_44", "secret: '", "'\n"), (1, "b64_40", "aws_secret_access_key = ", "\n"),
    (1, "akia", "with {w} ", " in the"), (1, "akia", "key id ", ", {w}"), (1, "akia", '"accessKeyId": "', '",'), (1, "alnum36", "export GITHUB_TOKEN=ghp_", "\n"), (1, "alnum24", "sk_live_", " for {w}"),
    (1, "alnum40", "Authorization: Bearer ", "\n"), (1, "b64_40", "Authorization: Basic ", "\r\n"), (1, "alnum24", "<password>", "</password>"), (1, "pass", "<pwd>", "</pwd>"), (1, "pass", "password = ", "\n{w}"),
    (1, "pass", "passwd: '", "' of {w}"), (1, "phrase", "passphrase = ", "\n"), (1, "phrase", 'password: "', '",'), (1, "uuid", "client_secret=", "&{w}=1"), (1, "uuid", 'auth_token: "', '"'),
    (1, "jwt", "token=", "."), (1, "jwt", "Cookie: session=", ";"), (1, "alnum32", "?access_token=", "&{w}"), (1, "alnum20", "DB_PASSWORD: ", "\n"), (1, "hex40", "private key {w} ", " do not share"), (1, "alnum32", "the secret is ", " for {w}"),
    (0, "hex40", "commit ", " by {w}"), (0, "hex40", "in the commit sha ", " of {w}"), (0, "hex64", "sha256: ", "\n"), (0, "hex32", "md5 checksum = ", "\n"), (0, "hex32", 'etag: "', '"'), (0, "hex40", "token stream digest ", " {w}"),
    (0, "digits16", "card ", " was {w}"), (0, "digits16", "{w} paid with ", " and"), (0, "digits12", "order no. ", "\n"), (0, "digits14", "token_count: ", "\n"), (0, "digits12", "primary_key = ", ","), (0, "digits13", "key = ", " {w}"),
    (0, "uuid", "request id ", " {w}"), (0, "uuid", '"uuid": "', '"'), (0, "uuid", "document key ", " {w}"), (0, "path", "see ", " for {w}"), (0, "path", "private/", "/{w}"), (0, "path", "key file at ", "\n"), (0, "ident", "key = ", "\n"), (0, "ident", 'token: "', '",'),
    (0, "ident", "access to ", " {w}"), (0, "ident", "password_field = ", "\n"), (0, "caps", "{w} ", " {w}"), (0, "caps", "KEY ", "!! {w}"), (0, "stamp", "build ", " {w}"), (0, "stamp", "token expires ", "\n"), (0, "b64_40", "data:image/png;base64,", " {w}"),
    (0, "b64_44", 'integrity="sha256-', '"'), (0, "hex64", "block hash ", " {w}"), (0, "alnum24", "https://{w}.org/watch/", "\n"), (0, "alnum20", "isbn or doi 10.1000/", " {w}"), (0, "placeholder", "password = ", "\n"), (0, "placeholder", 'api_key: "', '"'),
]
HELD_OUT = [
    (1, "hex40", "{w}_token = '", "' {w}"), (1, "alnum32", "X-Auth-Token: ", "\n"), (1, "akia", "{w} used ", "."), (1, "pass", '"pwd": "', '"'), (1, "phrase", "secret: ", "\n"), (1, "b64_44", "private_key={w}", "\n"), (1, "alnum40", "authorization: bearer ", " {w}"), (1, "alnum24", "<secret>", "</secret>"),
    (0, "hex40", "revision ", " {w}"), (0, "digits16", "invoice ", "\n"), (0, "digits14", "secret_count = ", "\n"), (0, "uuid", "guid ", " {w}"), (0, "path", "token file ", "\n"), (0, "ident", 'key: "', '"'), (0, "ident", "auth = ", " {w}"), (0, "caps", "TOKEN ", " {w}"), (0, "placeholder", "token = ", "\n"), (0, "hex64", "digest = ", "\n"), (0, "stamp", "version ", "\n"),
]


def _values(seed: Column) -> dict[str, Column]:
    """A value of each kind, from the hexadecimal digits of a hash."""
    h = F.concat(F.sha2(seed, 512), F.sha2(F.concat(seed, F.lit("+")), 512))
    b64 = F.base64(F.unhex(h))
    alnum, digits = F.regexp_replace(b64, "[+/=]", ""), F.translate(h, "abcdef", "172839")
    word = lambda k: F.element_at(F.array(*map(F.lit, WORDS)), F.pmod(F.xxhash64(seed, F.lit(k)), F.lit(len(WORDS))).cast("int") + 1)
    mark = F.element_at(F.array(*map(F.lit, "!@#_-.")), F.pmod(F.xxhash64(seed), F.lit(6)).cast("int") + 1)
    return {
        **{f"hex{n}": F.left(h, F.lit(n)) for n in (32, 40, 64)}, **{f"b64_{n}": F.left(b64, F.lit(n)) for n in (40, 44)}, **{f"alnum{n}": F.left(alnum, F.lit(n)) for n in (20, 24, 32, 36, 40)}, **{f"digits{n}": F.left(digits, F.lit(n)) for n in (12, 13, 14, 16)},
        "akia": F.concat(F.lit("AKIA"), F.left(F.upper(F.regexp_replace(b64, "[^A-Za-z2-7]", "")), F.lit(16))),
        "uuid": F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))),
        "jwt": F.concat(F.lit("eyJ"), F.left(alnum, F.lit(33))),
        "pass": F.concat(F.initcap(F.left(word(1), F.lit(5))), mark, F.left(digits, F.lit(3)), F.left(alnum, F.lit(2))),
        "phrase": F.concat_ws("-", word(1), word(2), word(3), word(4)),
        "path": F.concat_ws("/", F.lit("src"), word(1), F.concat(word(2), F.left(digits, F.lit(3))), word(3)),
        "ident": F.concat(word(1), F.lit("_"), word(2), F.lit("_"), F.left(digits, F.lit(4))),
        "caps": F.upper(F.concat(word(1), word(2), word(3))),
        "stamp": F.concat(F.lit("20"), F.left(digits, F.lit(6)), F.lit("T"), F.substring(digits, 7, 6), F.lit("Z")),
        "placeholder": F.concat(F.lit("your_"), word(1), F.lit("_here"), F.left(digits, F.lit(1))),
    }


def planted(spark: SparkSession, templates: list[tuple[int, str, str, str]], per_template: int = VALUES) -> DataFrame:
    """``doc_id, text, value, is_secret, template``: ``per_template`` texts of each template, the same at each call."""
    rows = spark.createDataFrame([(k, *t) for k, t in enumerate(templates)], "template int, is_secret int, kind string, before string, after string")
    rows = rows.withColumn("nth", F.explode(F.sequence(F.lit(1), F.lit(per_template))))
    seed = F.concat_ws(" ", "template", "before", "after", "nth")
    word = F.element_at(F.array(*map(F.lit, WORDS)), F.pmod(F.xxhash64(seed, F.lit("w")), F.lit(len(WORDS))).cast("int") + 1)
    made = _values(seed)
    value = F.coalesce(*(F.when(F.col("kind") == k, v) for k, v in made.items()))
    around = [F.replace(F.col(c), F.lit("{w}"), word) for c in ("before", "after")]
    doc = F.col("template") * 1_000_000 + F.col("nth")
    return rows.select(doc.cast("long").alias("doc_id"), F.concat(around[0], value, around[1]).alias("text"), value.alias("value"), "is_secret", "template")
