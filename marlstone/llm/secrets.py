"""Secret scan: candidates by pattern, false positives removed by a random forest.

A text is cut once, from left to right, into units that may hold candidates, and what lies between them: PEM blocks of private
keys (a BEGIN and the next END, with no other five dashes between), URLs with a user part, values set for names like
`password`, and long tokens. Each unit consumes what it looks at, so the time grows with the text, whatever it holds. A
candidate is a place within its unit: the block, the password of the URL (its user as well if that is a long token), the value
(in quotes up to the closing quote of the line, blanks included; else up to a blank, quote, comma, semicolon or bracket), or
the token (16 characters with a digit, 32 without that are not one character over and over, or a known shape). Each gets features: length, classes and transitions of
its characters, entropy, share covered by dictionary words, the path's words, and neighbouring words and punctuation. How
much character pairs, neighbouring words and path words speak for a secret is learned from the labelled findings too, as
logarithms of ratios. A random forest, trained from labelled findings, says which are secrets. The labelled findings are
made here from a seed by DataFrame functions (`labelled`; `n` rows, a fixed bound); a caller may give others.

Native: DataFrame functions and the JVM's random forest. Texts are read once and never shuffled, findings are
small rows; a document's findings are the only group. `redact` rewrites confirmed secrets; only documents with a
candidate go through its join.

Defined results: null and empty texts have no finding; rows are told apart by id and text, repeated rows have
their findings repeated; a missing or null path has no words; an empty table gives an empty result; other columns
are passed by (`redact` keeps them).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.llm.common import row_keys, table, written

N_LABELLED = 6000
TREES = 40
DEPTH = 8
THRESHOLD = 0.5
MASK = "[SECRET]"
NEAR = 60
LEAST = 5

#: What the names of secrets end with.
_NAMES = r"(?:(?i:password|passwd|passphrase|pwd|secret|token|api[_-]?key|apikey|access[_-]?key|auth[_-]?key|private[_-]?key|credential|credentials)|(?<![A-Za-z])(?i:pass)|(?<=[a-z])Pass)"
_MARK = r"[A-Za-z0-9_+/.\-]"
_WORD = r"[A-Za-z0-9_.\-]"
#: Shapes that are told by their beginning, with a digit or without.
_KNOWN = r"(?:(?:AKIA|ASIA)[A-Z0-9]{16}|(?:gh[pousr]_|npm_)[A-Za-z0-9]{30,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{30,})"
_PEM = r"-----BEGIN [A-Z0-9 ]*?PRIVATE KEY-----[^\-]*+(?:-(?!----)[^\-]*+){0,1000}+-----END [A-Z0-9 ]*?PRIVATE KEY-----"
_URL = r"[A-Za-z][A-Za-z0-9+.\-]*+://[^\s/@\"'<>]*+@"
_SIGN = r"[\"'`]?+\s*+(?::=|=>|={1,2}|:)\s*+"
#: Quoted without blanks; quoted with blanks, unless a long token stands within, which is a unit of its own then; not quoted.
_VALUE = "(?:" + "|".join(rf"{q}[^{q}\s]*+{q}|{q}(?![^{q}\n]*?{_MARK}{{14}})[^{q}\n]*+{q}" for q in "\"'`") + r"|[\"'`]?+[^\s\"'`,;<>()\[\]{}]++)"
_HEAD = rf"{_WORD}++(?={_SIGN})(?<={_NAMES}){_SIGN}(?![\"'`]?+-----BEGIN )"
_SET = f"{_HEAD}{_VALUE}"
#: A digit, 32 characters or a known shape.
_ODD = rf"(?:(?=[A-Za-z_+/.\-]*+[0-9])|(?={_MARK}{{32}})|(?={_KNOWN}))"
_TOKEN = rf"(?<![+/])(?={_MARK}{{14}}){_ODD}{_MARK}++(?!(?<={_NAMES})=)(?:={{1,2}}+(?![=A-Za-z0-9_+/.\-]))?+"
#: Short tokens joined by signs of equality, none of them the name of a secret.
_RUN = rf"(?<![=+/])(?=[=A-Za-z0-9_+/.\-]{{16}})(?![=A-Za-z0-9_+/.\-]*?(?:{_MARK}{{14}}|{_NAMES}=))[=A-Za-z0-9_+/.\-]++"
#: All but PEM blocks begin where no word goes on, with a long run or a word before a sign: that alone is looked at in plain prose.
_START = rf"(?<!{_WORD})(?=[=A-Za-z0-9_+/.\-]{{14}}|[A-Za-z0-9_+.\-]++[\"'`]?+\s*+[:=])"
UNIT = f"{_PEM}|{_START}(?:{_URL}|{_SET}|{_TOKEN}|{_RUN})"

#: Words that a placeholder or an identifier is made of.
DICTIONARY = "account admin array async base build button change changeme check class client cluster color column commit config content count create data date debug default delete demo digest document dummy email error example false field file filter float fake foo bar function global group guest handle hash header hello here html http https image index input insert item json key label length level line link list local login main master message method mock model module name node none null number object option order page panel param parent pass password path placeholder plain point port public query random read redacted release replace request response result root sample scale script secret select server service session setting size source start state status string style sub table target temp test text time title token true type undefined update upload user value version view west east north south www xxx your".split()
_GOOD = "(?i)(secret|token|passw|pwd|credential|api.?key|access.?key|auth|bearer|private)"
_BAD = "(?i)(commit|sha-?[0-9]|md5|checksum|digest|hash|uuid|guid|version|revision|example|sample|dummy|placeholder|test|mock|image|integrity|etag|isbn|serial|order|phone|card)"
_SHAPE = r"^(-----BEGIN [\s\S]*|AKIA[A-Z0-9]{16}|ASIA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{30,}|xox[abprs]-[A-Za-z0-9-]{10,}|eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_.-]+|sk-[A-Za-z0-9_-]{20,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{30,}|glpat-[A-Za-z0-9_-]{16,}|npm_[A-Za-z0-9]{30,})$"

FEATURES = ["f_length", "f_digits", "f_upper", "f_lower", "f_marks", "f_turns", "f_pairs", "f_entropy", "f_distinct", "f_words", "f_hex", "f_uuid", "f_shape", "f_run", "f_dots", "f_numeric", "f_path", "f_path_words", "f_near", "f_in_url", "f_good", "f_bad", "f_set", "f_quoted", "f_left_word"]


def _long(token: Column) -> Column:
    """Whether a token alone is a candidate."""
    n = F.length(token)
    return ((n >= 16) & token.rlike("[0-9]")) | ((n >= 32) & ~token.rlike(r"^(.)\1++$")) | token.rlike(f"^{_KNOWN}=*$")


def places(unit: Column) -> Column:
    """(piece, at, n) of each candidate of a unit: which of its kind, its place from 0, and its length."""
    length = F.length(unit)
    cut = lambda at, end: F.substr(unit, at + 1, end - at)
    one = lambda piece, at, end: F.struct(F.lit(piece).alias("piece"), at.cast("int").alias("at"), (end - at).cast("int").alias("n"))
    no = F.array().cast("array<struct<piece:int,at:int,n:int>>")
    zero = F.lit(0)
    # a URL: scheme://user:password@
    user = F.instr(unit, "://") + 2
    colon = F.position(F.lit(":"), unit, user + 1)
    end = length - 1
    user_end = F.when(colon > 0, colon - 1).otherwise(end)
    url = F.concat(
        F.when(_long(cut(user, user_end)), F.array(one(0, user, user_end))).otherwise(no),
        F.when((colon > 0) & (end - colon >= 3), F.array(one(1, colon, end))).otherwise(no),
    )
    # a value: from behind its sign and quote to its closing quote, if it has both
    head = F.length(F.regexp_extract(unit, rf"^{_HEAD}[\"'`]?+", 0))
    quote = F.substr(unit, head, F.lit(1))
    shut = quote.isin("\"", "'", "`") & (length > head) & (F.right(unit, F.lit(1)) == quote)  # a name's own quote is before its sign
    tail = F.when(shut, length - 1).otherwise(length)
    value = F.when(tail - head >= 6, F.array(one(0, head, tail))).otherwise(no)
    # a token, without full stops behind it
    stop = F.length(F.regexp_replace(unit, r"\.++$", ""))
    token = F.when(_long(cut(zero, stop)), F.array(one(0, zero, stop))).otherwise(no)
    pem = F.array(one(0, zero, length))
    return F.when(unit.startswith("-----BEGIN "), pem).when(unit.rlike(rf"^{_URL}$"), url).when(unit.rlike(rf"^{_HEAD}(?s:.)"), value).otherwise(token)


def units_of(text: Column) -> tuple[Column, Column]:
    """Units of a text, and what lies before, between and behind them."""
    return F.regexp_extract_all(text, F.lit(UNIT), F.lit(0)), F.split(text, UNIT)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None) -> DataFrame:
    """doc_id, k1, k2, no (4 for each unit, and the piece), start (code points before it), cand, left, right, path of each candidate."""
    path = F.coalesce(F.col(path_col), F.lit("")) if path_col else F.lit("")
    units, gaps = units_of(F.col(text_col))
    found = docs.filter(F.col(text_col).rlike(UNIT)).select(F.col(id_col).alias("doc_id"), *row_keys(id_col, text_col), path.alias("path"), units.alias("units"), gaps.alias("gaps"))
    found = found.withColumn("row", F.monotonically_increasing_id())
    each = F.transform(
        F.col("units"),
        lambda u, i: F.struct(
            F.length(F.get("gaps", i)).alias("before"),
            F.length(u).alias("length"),
            F.transform(
                places(u),
                lambda p: F.struct(
                    p["piece"].alias("piece"),
                    p["at"].alias("at"),
                    F.substr(u, p["at"] + 1, p["n"]).alias("cand"),
                    F.right(F.concat(F.right(F.get("gaps", i), F.lit(NEAR)), F.substr(u, F.lit(1), p["at"])), F.lit(NEAR)).alias("left"),
                    F.left(F.concat(F.substr(u, p["at"] + p["n"] + 1), F.left(F.get("gaps", i + 1), F.lit(NEAR))), F.lit(NEAR)).alias("right"),
                ),
            ).alias("pieces"),
        ),
    )
    rows = found.select("doc_id", "k1", "k2", "path", "row", F.posexplode(each).alias("no", "x"))
    rows = written(rows.select("doc_id", "k1", "k2", "path", "row", "no", "x.*"), "candidates")
    so_far = Window.partitionBy("row").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("first", F.sum(F.col("before") + F.col("length")).over(so_far) - F.col("length")).filter(F.size("pieces") > 0)
    rows = rows.select("doc_id", "k1", "k2", "path", "row", "no", "first", F.explode("pieces").alias("p"))
    return rows.select("doc_id", "k1", "k2", "path", "row", (F.col("no") * 4 + F.col("p.piece")).alias("no"), (F.col("first") + F.col("p.at")).alias("start"), "p.at", "p.cand", "p.left", "p.right")


def _share(c: Column, keep: str) -> Column:
    return F.length(F.regexp_replace(c, f"[^{keep}]", "")) / F.length(c)


#: Classes of characters in pairs: letters, any digit as 0, and 0 for all others.
CLASSES = "abcdefghijklmnopqrstuvwxyz0"


def _pairs(c: Column) -> Column:
    """Character pairs as numbers: 28 times the first one's class, and the second one's."""
    codes = F.transform(F.split(F.regexp_replace(F.lower(c), "[0-9]", "0"), ""), lambda x: F.when(x != "", F.instr(F.lit(CLASSES), x)))
    both = F.zip_with(codes, F.slice(codes, F.lit(2), F.greatest(F.length(c), F.lit(1))), lambda x, y: x * (len(CLASSES) + 1) + y)
    return F.filter(both, lambda x: x.isNotNull())


def _near_words(left: Column, right: Column) -> Column:
    """Words around a candidate: up to six before it and two after it."""
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z]{2,}"), F.lit(0))
    return F.concat(F.slice(F.reverse(words(left)), 1, 6), F.slice(words(right), 1, 2))


def _path_words(path: Column) -> Column:
    return F.regexp_extract_all(F.lower(path), F.lit("[a-z]{2,}"), F.lit(0))


@dataclass(frozen=True)
class Ratios:
    """Logarithms of how much more often something occurs in secrets than in others: for character pairs by number (a fixed
    size), neighbouring words and path words (those that occur `LEAST` times in the labelled findings at least)."""

    pairs: tuple[float, ...]
    near: dict[str, float]
    path: dict[str, float]


def _known(words: Column, ratios: dict[str, float]) -> Column:
    """The sum of the words' ratios."""
    if not ratios:
        return F.lit(0.0)
    table_ = F.create_map(*[F.lit(x) for kv in sorted(ratios.items()) for x in kv])
    return F.aggregate(words, F.lit(0.0), lambda acc, w: acc + F.coalesce(F.try_element_at(table_, w), F.lit(0.0)))


def featured(rows: DataFrame, ratios: Ratios) -> DataFrame:
    """Rows (cand, left, right, path, ...) with FEATURES, row by row."""
    c = F.col("cand")
    n = F.length(c)
    by_pair = F.array(*map(F.lit, ratios.pairs))
    pair_mean = F.aggregate(_pairs(c), F.lit(0.0), lambda acc, x: acc + F.get(by_pair, x)) / F.greatest(n - 1, F.lit(1))
    out = rows
    entropy = F.aggregate(
        F.array_distinct(F.split(c, "")),
        F.lit(0.0),
        lambda acc, x: F.when(x == "", acc).otherwise(acc - (n - F.length(F.replace(c, x, F.lit("")))) / n * F.log2((n - F.length(F.replace(c, x, F.lit("")))) / n)),
    )
    words = "(?i)(" + "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w))) + ")"
    flag = lambda x: F.coalesce(x.cast("double"), F.lit(0.0))
    return out.withColumns(
        {
            "f_length": F.log(n.cast("double")),
            "f_digits": _share(c, "0-9"),
            "f_upper": _share(c, "A-Z"),
            "f_lower": _share(c, "a-z"),
            "f_marks": _share(c, r"+/=_.\-"),
            "f_pairs": pair_mean,
            "f_turns": F.regexp_count(c, F.lit("(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[a-z])(?=[A-Z])")) / n,
            "f_entropy": entropy,
            "f_distinct": F.size(F.array_distinct(F.split(c, ""))) / n,
            "f_words": F.lit(1.0) - F.length(F.regexp_replace(c, words, "")) / n,
            "f_hex": flag(c.rlike("^[0-9a-fA-F]+$")),
            "f_uuid": flag(c.rlike("^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$")),
            "f_shape": flag(c.rlike(_SHAPE)),
            "f_run": flag(c.rlike(r"(.)\1{3,}|0123|1234|abcd")),
            "f_dots": F.regexp_count(c, F.lit(r"[./]")) / n,
            "f_numeric": flag(c.rlike(r"^[0-9.+/:\-]+$")),
            "f_path": flag(F.col("path").rlike("(?i)(test|example|sample|fixture|spec|mock|doc)")),
            "f_path_words": _known(_path_words(F.col("path")), ratios.path),
            "f_near": _known(_near_words(F.col("left"), F.col("right")), ratios.near),
            "f_in_url": flag(F.col("left").rlike(r"://[^\s/:@]*:$") & F.col("right").startswith("@")),
            "f_good": flag(F.col("left").rlike(_GOOD)),
            "f_bad": flag(F.col("left").rlike(_BAD) | F.col("right").rlike("(?i)^.{0,12}(example|placeholder|dummy)")),
            "f_set": flag(F.col("left").rlike("[:=]\\s*[\"']?$")),
            "f_quoted": flag(F.col("left").rlike("[\"'`]$") & F.col("right").rlike("^[\"'`]")),
            "f_left_word": flag(F.col("left").rlike(r"\p{L}{2,}\s+$")),
        }
    )


def made_findings(spark: SparkSession, n: int = N_LABELLED) -> DataFrame:
    """Findings labelled by construction, in their text: id, label (1: a secret), made, before, after, path."""
    h = F.sha2(F.concat(F.lit("finding "), F.col("id").cast("string")).cast("binary"), 512)
    b64 = F.regexp_replace(F.base64(F.unhex(h)), "[\r\n]", "")
    draw = lambda k, m: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(m)).cast("int")
    of = lambda k, *xs: F.get(F.array(*[x if isinstance(x, Column) else F.lit(x) for x in xs]), draw(k, len(xs)))
    cut = lambda s, k, low, high: F.substring(s, F.lit(1), F.lit(low) + draw(k, high - low + 1))
    plain = F.regexp_replace(b64, "[+/=]", "")
    secret = of(
        "kind",
        F.substring(h, F.lit(1), F.lit(40)),
        F.substring(h, F.lit(1), F.lit(32)),
        F.upper(F.substring(h, F.lit(1), F.lit(40))),
        F.substring(h, F.lit(1), F.lit(64)),
        cut(b64, "cut", 24, 64),
        cut(plain, "cut", 20, 48),
        F.concat(F.lit("AKIA"), F.upper(F.substring(plain, F.lit(1), F.lit(16)))),
        F.concat(of("pre", "ghp_", "sk-", "sk_live_", "glpat-", "npm_", "AIza"), F.substring(plain, F.lit(1), F.lit(36))),
        F.concat(F.lit("eyJ"), F.substring(plain, F.lit(1), F.lit(20)), F.lit(".eyJ"), F.substring(plain, F.lit(21), F.lit(40)), F.lit("."), F.substring(h, F.lit(1), F.lit(30))),
        F.concat(of("w1", "Sun", "tr0ub", "Blue", "x9", "Zeta"), of("w2", "!", "#", "_", "$"), cut(plain, "cut", 5, 10)),
        F.concat(of("w3", "", "Sun", "pa55", "k"), cut(plain, "cut", 6, 20)),
        F.concat(cut(plain, "cut", 3, 6), of("p1", ",", ";", "(", "&"), cut(F.reverse(plain), "cut2", 2, 5), of("p2", ")", "!", "]", "#", "%"), F.substring(h, F.lit(1), F.lit(3))),
        F.concat_ws(" ", of("w4", "purple", "Tango", "gravel", "Orchid", "seven"), of("w5", "kayak", "Walrus", "42", "ember", "quartz"), of("w6", "over", "Lima", "9th", "saddle", "nectar"), cut(F.lower(plain), "cut", 3, 7)),
        F.substring(F.translate(F.concat(plain, F.reverse(plain)), "0123456789", ""), F.lit(1), F.lit(40)),
        F.concat_ws("\n", F.concat(F.lit("-----BEGIN "), of("pem", "RSA ", "", "EC ", "OPENSSH ", "ENCRYPTED "), F.lit("PRIVATE KEY-----")), F.repeat(F.concat(b64, F.lit("\n")), F.lit(1) + draw("lines", 20)), F.concat(F.lit("-----END "), of("pem", "RSA ", "", "EC ", "OPENSSH ", "ENCRYPTED "), F.lit("PRIVATE KEY-----"))),
    )
    names = of("name", "token", "TOKEN", "secret", "api_key", "apiKey", "API_KEY", "password", "access_key", "auth_token", "client_secret", "private_key")
    opening = F.concat(of("lead", "", " ", "export ", "\n", "the ", "set "), names, of("sign", " = \"", "=\"", ": \"", " = '", "=", ": ", "\": \""))
    bare = of("lead", "", " ", "use ", "see ", "with ", "key ", "\n", "(", "- ", "id: ", "the ", "and ")
    closing = F.concat(of("end", "\"", "'", "\"", "", "\n"), of("tail", " and", "\n", "", " #", ";"))
    word = of("word", *DICTIONARY[::7])
    other = of("word2", *DICTIONARY[3::7])
    digits = F.regexp_replace(h, "[^0-9]", "")
    innocent = of(
        "not",
        F.substring(h, F.lit(1), F.lit(40)),
        F.substring(h, F.lit(1), F.lit(64)),
        F.substring(h, F.lit(1), F.lit(32)),
        F.concat_ws("-", F.substring(h, F.lit(1), F.lit(8)), F.substring(h, F.lit(9), F.lit(4)), F.substring(h, F.lit(13), F.lit(4)), F.substring(h, F.lit(17), F.lit(4)), F.substring(h, F.lit(21), F.lit(12))),
        F.concat_ws("_", F.lit("your"), word, F.lit("key"), F.lit("here1")),
        F.concat(F.repeat(of("x", "x", "0", "*", "X", "1"), F.lit(20)), F.lit("0")),
        F.array_join(F.array(word, other, F.lit("example"), draw("no", 99).cast("string")), "_"),
        F.concat_ws("/", F.lit("www.site.com"), word, other, F.substring(digits, F.lit(1), F.lit(4))),
        F.concat_ws("-", F.substring(digits, F.lit(1), F.lit(4)), F.substring(digits, F.lit(5), F.lit(4)), F.substring(digits, F.lit(9), F.lit(4)), F.substring(digits, F.lit(13), F.lit(4))),
        F.substring(digits, F.lit(1), F.lit(16)),
        F.concat(F.initcap(word), F.initcap(other), F.initcap(word), F.lit("V2"), F.initcap(other)),
        F.concat_ws(".", F.lit("v1"), draw("a", 30).cast("string"), draw("b", 30).cast("string"), F.lit("release"), F.substring(digits, F.lit(1), F.lit(8))),
        F.concat(F.lit("changeme"), draw("no", 9999).cast("string")),
        F.concat_ws("_", word, other, word, F.lit("config"), draw("no", 99).cast("string")),
        F.concat_ws(" ", of("w7", "your", "the", "enter", "see"), word, other, of("w8", "here", "value", "of the user", "goes here")),
        F.concat(of("stand", "password", "changeme", "your_password", "secret", "example", "pass", "xxxxxx", "PASSWORD"), of("in", "", "1", "123")),
    )
    kind = draw("not", 16)
    quote = of("quote", "\"", "'")
    quoted = F.concat(of("lead", "", " ", "export ", "\n"), names, of("sign2", "=", " = ", ": ", ":    "), quote)
    url = F.concat(of("lead", "", " ", "see ", "url: "), of("scheme", "postgres://", "mysql://", "https://", "redis://", "amqp://", "mongodb://"), of("who", "user", "admin", "app", "root", "svc7"), F.lit(":"))
    host = F.concat(F.lit("@"), of("host", "db.internal", "10.0.0.5", "example.com", "localhost"), of("tail", "/x", "", ":5432/app", " and"))
    calm = of("calm", "commit ", "sha256:", "md5 = ", "checksum: ", "integrity ", "see ", "version ", "id: ", "uuid=", "digest \"", "hash: ", "revision ", "", "the file ", "etag=\"")
    trap = F.when(kind >= 4, F.when(draw("trap", 2) == 0, opening).otherwise(calm)).otherwise(calm)
    trap = F.when(kind == 15, url).when(kind == 14, quoted).otherwise(trap)
    form = draw("kind", 15)
    shaped = (form >= 6) & (form <= 8)
    named = F.when((form == 14) | (form == 13) & (draw("bare", 2) == 0) | shaped & (draw("bare", 2) == 0), bare).when(form == 10, url).when((form == 11) | (form == 12), quoted).otherwise(opening)
    in_url = F.when(F.col("id") % 2 == 1, form == 10).otherwise(kind == 15)
    in_quotes = F.when(F.col("id") % 2 == 1, (form == 11) | (form == 12)).otherwise(kind == 14)
    made = spark.range(0, n, 1, 1).select(
        "id",
        (F.col("id") % 2).cast("double").alias("label"),
        F.when(F.col("id") % 2 == 1, secret).otherwise(innocent).alias("made"),
        F.concat(F.repeat(F.concat(other, F.lit(" ")), draw("pad", 4)), F.when(F.col("id") % 2 == 1, named).otherwise(trap)).alias("before"),
        F.when(in_url, host).when(in_quotes, F.concat(quote, of("tail", " and", "\n", "", " #", ";"))).otherwise(closing).alias("after"),
        F.when(F.col("id") % 2 == 1, of("p1", "src/app", "config/prod", "", "deploy/env", "tests/unit")).otherwise(of("p2", "src/app", "docs/example", "", "tests/fixture", "data")).alias("path"),
    )
    return made


def labelled(spark: SparkSession, n: int = N_LABELLED) -> DataFrame:
    """Findings labelled by construction, n less the few that candidates() passes by: id, cand, left, right, path, label (1: a secret)."""
    return as_found(made_findings(spark, n))


def as_found(made: DataFrame) -> DataFrame:
    """Made findings (id, label, made, before, after, path) as candidates() cuts them from their text: cand, left, right. Those it doesn't find go."""
    found = candidates(made.select("id", F.concat("before", "made", "after").alias("text")), "id").drop("path")
    # the candidate that holds the last character of what was made
    rows = found.join(made.withColumn("end", F.length("before") + F.length("made")), F.col("doc_id") == F.col("id"))
    rows = rows.filter((F.col("start") < F.col("end")) & (F.col("start") + F.length("cand") >= F.col("end")))
    return rows.select("id", "label", "cand", "left", "right", "path")


def ratios_of(rows: DataFrame) -> Ratios:
    """From labelled findings: what they hold of each pair and word comes to the driver, bounded by their number."""

    def log_ratios(items: Column, least: int) -> dict:
        per = rows.select("label", F.explode(items).alias("x")).groupBy("x").agg(F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b")).collect()
        a, b = sum(r.a for r in per) + 1, sum(r.b for r in per) + 1
        return {r.x: math.log((r.a + 1) / a / ((r.b + 1) / b)) for r in per if r.a + r.b >= least}

    pairs = log_ratios(_pairs(F.col("cand")), 0)
    near = log_ratios(_near_words(F.col("left"), F.col("right")), LEAST)
    return Ratios(tuple(pairs.get(k, 0.0) for k in range((len(CLASSES) + 1) ** 2)), near, log_ratios(_path_words(F.col("path")), LEAST))


def train(rows: DataFrame, trees: int = TREES, depth: int = DEPTH):
    """(model, ratios) from labelled findings."""
    rows = written(rows.coalesce(1), "labelled")
    ratios = ratios_of(rows)
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(written(featured(rows, ratios).coalesce(1).sortWithinPartitions("id"), "featured"))
    forest = RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=trees, maxDepth=depth, seed=5)
    return forest.fit(vectors), ratios


def judged(rows: DataFrame, model, ratios: Ratios, threshold: float = THRESHOLD) -> DataFrame:
    """Rows with score and is_secret."""
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(featured(rows, ratios))
    scored = model.transform(vectors).withColumn("score", vector_to_array("probability")[1])
    return scored.drop(*FEATURES, "features", "rawPrediction", "probability", "prediction").withColumn("is_secret", F.col("score") >= threshold)


def scan(docs: DataFrame, findings: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None) -> DataFrame:
    """Each candidate of each document: doc_id, k1, k2, row, no, start, cand, score, is_secret."""
    model, ratios = train(labelled(docs.sparkSession) if findings is None else findings)
    return judged(candidates(docs, id_col, text_col, path_col), model, ratios)


def redact(docs: DataFrame, findings: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None, mask: str = MASK) -> DataFrame:
    """docs, all columns and rows, with confirmed secrets replaced by the mask."""
    has = F.coalesce(F.col(text_col).rlike(UNIT), F.lit(False))
    found = scan(docs, findings, id_col, text_col, path_col)
    flags = found.filter("is_secret").groupBy("k1", "k2").agg(F.array_sort(F.collect_set(F.struct(F.expr("no div 4").alias("unit"), "at", F.length("cand").alias("n")))).alias("__flags"))  # of one document's text
    k1, k2 = row_keys(id_col, text_col)
    touched = docs.filter(has).withColumns({"__k1": k1, "__k2": k2})
    touched = touched.join(flags.withColumnsRenamed({"k1": "__k1", "k2": "__k2"}), ["__k1", "__k2"], "left")
    units, gaps = units_of(F.col(text_col))

    def masked(unit: Column, number: Column) -> Column:
        """A unit with its confirmed candidates replaced, the last one first."""
        gone = F.reverse(F.filter("__flags", lambda f: f["unit"] == number))
        return F.aggregate(gone, unit, lambda u, f: F.concat(F.substr(u, F.lit(1), f["at"]), F.lit(mask), F.substr(u, f["at"] + f["n"] + 1)))

    pieces = F.zip_with(gaps, F.transform(units, masked), lambda g, u: F.concat(g, F.coalesce(u, F.lit(""))))
    rebuilt = F.when(F.col("__flags").isNull(), F.col(text_col)).otherwise(F.array_join(pieces, ""))
    return docs.filter(~has).unionByName(touched.withColumn(text_col, rebuilt).select(*docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: every candidate in every document, judged."""
    docs = table(spark, sf_dir, "documents")
    out = scan(docs, path_col="source")
    return out.select("doc_id", F.col("start").cast("long").alias("start"), F.length("cand").cast("long").alias("length"), F.sha2(F.col("cand").cast("binary"), 256).alias("cand_sha256"), "score", "is_secret")
