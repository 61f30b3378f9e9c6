"""Secret scans: keyed assignments, access keys, hex digests, and a randomness test battery.

DataFrame functions only. Candidate strings get an encoding from the kinds of symbols in them
(hex, base32 and base36 in either case, base62, base64; letters of one small case alone count as
base64, as words do) and tests of the hypothesis that they are uniform random symbols:
chi-squared over the alphabet, Wald-Wolfowitz runs about its middle, lag-one serial correlation,
and beyond hex the number of neighbouring letters that are common pairs in words; in base32 and
base36 also the share of common letters, in base62 and base64 that of small letters after
letters, in hex the odds of digits alone or letters alone. The
smallest p-value (times the number of tests) counts; a Benjamini-Hochberg step in each length class, over a fixed grid of
p-values, rejects what is not random. Candidates that it cannot reject are secrets.

A candidate is a run of encoding symbols without the readable words before and after it
(``sk-``, the folders of a path), or a UUID. Where the whole is rejected, its parts between
``/``, ``+``, ``-`` and ``_`` are candidates of their own. Strings of fewer than FLOOR symbols are
not tested: the tests cannot tell them from words. Strings of small letters alone are never
secrets, and digits alone hardly ever.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import staged
from ._text import blocks_sql, chunks_sql, cut_sql

# Fixed patterns of the base rules.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: The shortest candidate.
FLOOR = 16
UUID = r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}(?![A-Za-z0-9+/_=-])"


def candidate(floor: int) -> str:
    """Pattern of the runs that the test battery looks at; a sign before a value is not padding."""
    return rf"(?<![A-Za-z0-9+/_-])(?:{UUID}|[A-Za-z0-9+/_-]{{{floor},}}+(?:={{1,2}}(?![A-Za-z0-9+/_=-]))?)"


#: Readable words before a key, and after it in its reverse.
BEFORE = r"^(?:[+/_-]*+(?:[a-z]{2,}+[0-9]?+|[a-z][0-9])[+/_-])*+[+/_-]*+"
AFTER = r"^[+/_-]*+(?:[a-z]{3,}+[+/_-]++)*+"
KINDS = ("assign", "access", "hex", "random")
_WORDS = ("passw", "secret", "token", "apikey", "api_key")

_SPANS = "array<struct<s:int,k:int,e:int,m:string>>"


def _place(matches: str, gaps: str, kind: int) -> str:
    """SQL for the spans (start, kind, end, match) of matches with the texts between them, in code points."""
    pairs = f"zip_with(slice({gaps}, 1, size({matches})), {matches}, (g, m) -> struct(length(g) as g, m as m))"
    starts = "aggregate(bs, cast(array(0) as array<int>), (a, b) -> concat(a, array(a[size(a) - 1] + aggregate(b, 0, (n, x) -> n + x.g + length(x.m)))))"
    block = f"""aggregate(b, struct(at as at, cast(array() as {_SPANS}) as out), (a, x) -> struct(
        a.at + x.g + length(x.m) as at,
        concat(a.out, array(struct(a.at + x.g as s, {kind} as k, a.at + x.g + length(x.m) as e, x.m as m))) as out), a -> a.out)"""
    # A transform of a one-element array names a value that is used more than once.
    blocks = f"transform(array({pairs}), ps -> {blocks_sql('ps')})"
    return f"transform({blocks}, bs -> flatten(zip_with(bs, slice({starts}, 1, size(bs)), (b, at) -> {block})))[0]"


def base_spans(docs: DataFrame, text: str = "text", floor: int = FLOOR) -> DataFrame:
    """Adds ``base`` (all base spans by start, then kind) and ``cands`` (candidates outside them)."""
    none = "cast(array() as array<string>)"
    q = lambda p: "'" + p.replace("\\", "\\\\").replace("'", "\\'") + "'"
    runs = candidate(floor)
    low = F.lower(text)
    keyed = F.lit(False)
    for w in _WORDS:
        keyed = keyed | F.contains(low, F.lit(w))
    d = docs.withColumn("_keyed", F.coalesce(keyed, F.lit(False))).withColumn("_aws", F.coalesce(F.contains(F.col(text), F.lit("AKIA")), F.lit(False)))
    d = d.select(
        "*",
        F.expr(f"if(_keyed, regexp_extract_all({text}, {q(ASSIGN)}, 0), {none}) as _m0"),
        F.expr(f"if(_aws, regexp_extract_all({text}, {q(ACCESS)}, 0), {none}) as _m1"),
        F.expr(f"coalesce(regexp_extract_all({text}, {q(HEX)}, 0), {none}) as _m2"),
        F.expr(f"coalesce(regexp_extract_all({text}, {q(runs)}, 0), {none}) as _m3"),
    )
    patterns = (ASSIGN, ACCESS, HEX, runs)
    d = d.select("*", *[F.expr(f"if(size(_m{k}) > 0, split({text}, {q(p)}), {none}) as _g{k}") for k, p in enumerate(patterns)], F.expr(f"if(size(_m0) > 0, regexp_extract_all({text}, {q(ASSIGN)}, 2), {none}) as _v0"))
    d = d.select("*", *[F.expr(f"if(size(_m{k}) > 0, {_place(f'_m{k}', f'_g{k}', k)}, cast(array() as {_SPANS})) as _s{k}") for k in range(4)])
    kept = "transform(filter(zip_with(_s0, _v0, (s, v) -> struct(s as s, v as v)), x -> length(x.v) >= 8), x -> x.s)"
    d = d.withColumn("base", F.expr(f"if(size(_s0) + size(_s1) + size(_s2) > 0, array_sort(concat({kept}, _s1, _s2)), cast(array() as {_SPANS}))"))
    # Candidates are in order and apart: a block of them meets only the base spans in its range.
    free = "transform(array(filter(base, s -> s.s < b[size(b) - 1].e and b[0].s < s.e)), near -> filter(b, c -> not exists(near, s -> s.s < c.e and c.s < s.e)))[0]"
    d = d.withColumn("cands", F.expr(f"if(size(_s3) = 0 or size(base) = 0, _s3, flatten(transform({blocks_sql('_s3')}, b -> {free})))"))
    return d.drop("_keyed", "_aws", *[f"_{x}{k}" for x in "mgs" for k in range(4)], "_v0")


# Symbols of each encoding in the order of their values.
_ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
#: The commonest letters in words of European languages: two thirds of their letters, a third of random ones.
_COMMON = "AEILNORST"
#: Pairs of letters that are common in words of English, German, French and Spanish.
_PAIRS = (
    "TH HE IN ER AN RE ON AT EN ND TI ES OR TE OF ED IS IT AL AR ST TO NT SE HA AS OU IO LE VE CO ME DE HI RI RO IC NE EA RA CE "
    "CH LA EL UR US IE EI GE UN TA MA LI NO LL DI SI BE SC IC ET AI QU UE AD OS DO"
)
_BINS = 256


def p_values(cands: DataFrame) -> DataFrame:
    """Adds ``p``, the combined p-value that string ``m`` is random in its encoding, and ``length_class``."""
    plain = F.when(F.col("m").rlike(f"^{UUID}$"), F.translate("m", "-", "")).otherwise(F.regexp_replace("m", "=+$", ""))
    d = cands.withColumn("_t", F.translate(plain, "-_", "+/"))
    code = F.when(F.col("_t").rlike("^([0-9a-f]+|[0-9A-F]+)$"), "hex").when(F.col("_t").rlike("^([A-Z2-7]+|(?=.*[2-7])[a-z2-7]+)$"), "base32")
    code = code.when(F.col("_t").rlike("^([A-Z0-9]+|(?=.*[0-9])[a-z0-9]+)$"), "base36").when(F.col("_t").rlike("^(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9]+$"), "base62").otherwise("base64")
    fold = F.when(F.col("_code") == "hex", F.lower("_t")).when(F.col("_code").isin("base32", "base36"), F.upper("_t")).otherwise(F.col("_t"))
    d = d.withColumn("_code", code).withColumn("_t", fold)
    symbols = F.lit(_ALPHABETS["base64"])
    for name in ("hex", "base32", "base36", "base62"):
        symbols = F.when(F.col("_code") == name, _ALPHABETS[name]).otherwise(symbols)
    d = d.withColumn("_abc", symbols).withColumn("_k", F.length("_abc")).withColumn("_n", F.length("_t"))
    d = d.withColumn("_x", F.expr("transform(filter(split(_t, ''), c -> c <> ''), c -> cast(instr(_abc, c) - 1 as double))"))
    # Chi-squared: over symbols for small alphabets, over letter case, digits and signs for base62 and base64.
    per_symbol = "aggregate(sequence(0, _k - 1), 0D, (a, i) -> a + power(size(filter(_x, v -> v = i)) - _n / _k, 2) / (_n / _k))"
    share = lambda low, high: f"power(size(filter(_x, v -> v >= {low} and v < {high})) - _n * {high - low} / _k, 2) / (_n * {high - low} / _k)"
    d = d.withColumn("_chi", F.expr(f"if(_k >= 62, {share(0, 26)} + {share(26, 52)} + {share(52, 62)} + if(_k = 64, {share(62, 64)}, 0D), {per_symbol})"))
    d = d.withColumn("_df", F.expr("case _k when 64 then 3 when 62 then 2 else _k - 1 end"))
    # Runs about the middle of the alphabet.
    d = d.withColumn("_up", F.expr("size(filter(_x, v -> v >= _k / 2))")).withColumn("_down", F.expr("_n - _up"))
    d = d.withColumn("_runs", F.expr("1 + size(filter(sequence(2, greatest(_n, 2)), i -> (_x[i - 1] >= _k / 2) <> (_x[i - 2] >= _k / 2)))"))
    d = d.withColumn("_mu", F.expr("1 + 2D * _up * _down / _n")).withColumn("_var", F.expr("(_mu - 1) * (_mu - 2) / greatest(_n - 1, 1)"))
    # Serial correlation at lag one.
    d = d.withColumn("_mean", F.expr("aggregate(_x, 0D, (a, v) -> a + v) / _n"))
    d = d.withColumn("_ss", F.expr("aggregate(_x, 0D, (a, v) -> a + power(v - _mean, 2))"))
    d = d.withColumn("_lag", F.expr("aggregate(sequence(2, greatest(_n, 2)), 0D, (a, i) -> a + (_x[i - 1] - _mean) * (_x[i - 2] - _mean))"))
    tail = lambda z: f"1 / (1 + exp(least(1.5976 * ({z}) + 0.07056 * power({z}, 3), 700D)))"  # noqa: E731  normal tail, logistic form
    chi = tail("(power(_chi / _df, 1D / 3) - (1 - 2D / (9 * _df))) / sqrt(2D / (9 * _df))")
    runs = f"if(_var > 0, 2 * {tail('abs(_runs - _mu) / sqrt(_var)')}, 0D)"
    serial = f"if(_ss > 0, 2 * {tail('abs(_lag / _ss) * sqrt(_n)')}, 0D)"
    # Common letters, one-sided.
    d = d.withColumn("_letters", F.expr("length(regexp_replace(_t, '[^A-Z]', ''))")).withColumn("_common", F.expr(f"length(regexp_replace(_t, '[^{_COMMON}]', ''))"))
    share_of = len(_COMMON) / 26
    common = f"if(_k in (32, 36) and _letters > 0, {tail(f'(_common - _letters * {share_of}D) / sqrt(greatest(_letters, 1) * {share_of * (1 - share_of)}D)')}, 1D)"
    # Common pairs of neighbouring letters, the second small in mixed case, one-sided: the Poisson tail at their share of random pairs.
    pairs = ", ".join(f"'{x}'" for x in _PAIRS.split())
    d = d.withColumn("_two", F.expr("transform(sequence(1, greatest(_n - 1, 1)), i -> substring(_t, i, 2))"))
    d = d.withColumn("_rate", F.expr(f"(_n - 1) * {len(_PAIRS.split()) / 26**2}D * if(_k >= 62, 52 * 26, 26 * 26) / (_k * _k)"))
    d = d.withColumn("_seen", F.expr(f"size(filter(_two, w -> upper(w) in ({pairs}) and (_k < 62 or w rlike '[a-z]$')))"))
    below = "aggregate(sequence(1, _seen), struct(exp(-_rate) as term, 0D as sum), (a, i) -> struct(a.term * _rate / i as term, a.sum + a.term as sum), a -> a.sum)"
    words = f"if(_k > 16 and _seen > 0, greatest(1 - {below}, 0D), 1D)"
    # Small letters after letters, one-sided; pairs that overlap depend on each other.
    d = d.withColumn("_small", F.expr("size(filter(_two, w -> w rlike '^[A-Za-z][a-z]$'))")).withColumn("_p2", F.expr("52D * 26 / (_k * _k)")).withColumn("_p3", F.expr("_p2 * 26 / _k"))
    small = tail("(_small - (_n - 1) * _p2) / sqrt((_n - 1) * (_p2 + 2 * _p3 - 3 * _p2 * _p2))")
    cased = f"if(_k >= 62, {small}, 1D)"
    # Digits alone or letters alone in hex.
    d = d.withColumn("_digits", F.expr("length(regexp_replace(_t, '[^0-9]', ''))"))
    kind = "if(_k = 16 and _digits = _n, power(10 / 16D, _n), if(_k = 16 and _digits = 0, power(6 / 16D, _n), 1D))"
    tests = "if(_k = 16, 4, 5)"
    d = d.withColumn("p", F.expr(f"least(1D, {tests} * least({chi}, {runs}, {serial}, {common}, {words}, {cased}, {kind}))")).withColumn("length_class", F.expr("cast(floor(4 * log2(_n)) as int)"))
    return d.drop(*[c for c in d.columns if c.startswith("_")])


#: Level of the false-discovery control: the share of random strings among those that it rejects.
Q = 0.01


def candidates(runs: DataFrame, floor: int = FLOOR) -> DataFrame:
    """(row, run, part, s, e, m) from runs (row, s, e, m): each without the words around it, and its parts.

    ``run`` is where the run begins; ``part`` is false for the whole. What has fewer symbols than
    ``floor`` is left out.
    """
    d = runs.withColumn("_uuid", F.col("m").rlike(f"^{UUID}$"))
    before = F.when(F.col("_uuid"), 0).otherwise(F.length(F.regexp_extract("m", BEFORE, 0)))
    d = d.withColumn("_at", F.col("s") + before).withColumn("_m", F.expr("substring(m, _at - s + 1, length(m))"))
    after = F.when(F.col("_uuid"), 0).otherwise(F.length(F.regexp_extract(F.reverse("_m"), AFTER, 0)))
    d = d.withColumn("_m", F.substring("_m", F.lit(1), F.length("_m") - after))
    piece = f"[A-Za-z0-9]{{{floor},}}"
    d = d.select("*", F.expr(f"if(_uuid or not _m rlike '[+/_-]', cast(array() as array<string>), regexp_extract_all(_m, '{piece}', 0)) as _ms"), F.expr(f"split(_m, '{piece}') as _gs"))
    d = d.withColumn("_parts", F.expr(f"if(size(_ms) > 0, {_place('_ms', '_gs', 3)}, cast(array() as {_SPANS}))"))
    whole = f"if(length(rtrim('=', _m)) >= {floor}, array(struct(false as part, _at as s, _at + length(_m) as e, _m as m)), array())"
    parts = "transform(_parts, x -> struct(true as part, _at + x.s as s, _at + x.e as e, x.m as m))"
    return d.select("row", F.col("s").alias("run"), F.explode(F.expr(f"concat({whole}, {parts})")).alias("c")).select("row", "run", "c.*")


def random_strings(cands: DataFrame, q: float = Q) -> DataFrame:
    """Candidates that stay random: not rejected by Benjamini-Hochberg at level q in their length class."""
    step = F.expr(f"cast(least({_BINS - 1}, floor(-8 * log2(greatest(p, 1e-9)))) as int)").alias("bin")  # larger bin: smaller p
    tested = staged(p_values(cands).select("*", step), "tested")
    counts = tested.groupBy("length_class", "bin").agg(F.count("*").alias("n"))
    by = Window.partitionBy("length_class")
    counts = counts.withColumn("below", F.sum("n").over(by.orderBy(F.desc("bin")))).withColumn("all", F.sum("n").over(by))
    edge = counts.where(f"power(2D, -bin / 8D) * all <= {q} * below").groupBy("length_class").agg(F.min("bin").alias("edge"))
    return tested.join(edge.withColumnRenamed("length_class", "lc"), F.col("length_class") == F.col("lc"), "left").where("edge is null or bin < edge").drop("lc", "edge", "bin")


def scan(docs: DataFrame, q: float = Q, keep: tuple[str, ...] = ("doc_id",), floor: int = FLOOR) -> DataFrame:
    """Columns ``keep`` plus ``base`` and ``all``: arrays of (s start, k kind, e end, m match), by start then kind.

    Positions are code points, ends exclusive. A null text counts as empty and has no spans.
    Repeated rows are scanned each; an empty table gives no rows; other columns are ignored.
    Texts of any length are scanned whole, in time that grows with their length.
    """
    d = docs.select(*[docs[c] for c in dict.fromkeys((*keep, "text"))]).withColumn("row", F.monotonically_increasing_id())
    if "text" not in keep:
        first = base_spans(d, floor=floor).drop("text")
    else:
        first = base_spans(d, floor=floor)
    first = staged(first, "spans")
    runs = first.where("size(cands) > 0").select("row", F.explode("cands").alias("c")).select("row", "c.s", "c.e", "c.m")
    found = random_strings(candidates(runs, floor), q).groupBy("row", "run").agg(F.bool_or(~F.col("part")).alias("whole"), F.collect_list(F.struct("part", "s", "e", "m")).alias("found"))
    found = found.withColumn("found", F.expr("transform(filter(found, x -> not whole or not x.part), x -> struct(x.s as s, 3 as k, x.e as e, x.m as m))"))
    more = found.groupBy("row").agg(F.flatten(F.collect_list("found")).alias("more"))
    joined = first.drop("cands").join(more.withColumnRenamed("row", "r"), F.col("row") == F.col("r"), "left")
    return joined.withColumn("all", F.expr("if(more is null, base, array_sort(concat(base, more)))")).drop("row", "r", "more")


def _text_of(spans: str) -> str:
    names = "element_at(array('assign', 'access', 'hex', 'random'), x.k + 1)"
    return f"concat_ws(',', transform({spans}, x -> concat({names}, ':', x.s, ':', x.e)))"


def secret_scan(docs: DataFrame, q: float = Q) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random) of each row of ``docs``; see ``scan``."""
    count = lambda k: F.expr(f"cast(size(filter(base, x -> x.k = {k})) as long)")
    return scan(docs, q).select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(F.expr(_text_of("base")), 256).alias("base_sha256"),
        F.expr(_text_of("all")).alias("spans"), F.expr("cast(size(all) - size(base) as long)").alias("n_random"),
    )


def redact(docs: DataFrame, columns: list[str], q: float = Q, mark: str = "[SECRET]") -> DataFrame:
    """``columns`` of ``docs`` with every span of ``text`` replaced by ``mark``; overlapping spans become one.

    Null texts stay null and texts without spans stay as they are; repeated rows are each
    redacted, an empty table gives no rows, and other columns are left out. Time grows with the
    length of a text and its number of spans, not with their product.
    """
    d = scan(docs, q, tuple(columns))
    # Each span with the furthest end before it: where that is no further than its start, a new cut begins.
    ends = "aggregate(bs, array(0), (a, b) -> concat(a, array(greatest(a[size(a) - 1], array_max(transform(b, x -> x.e))))))"
    block = """aggregate(b, struct(at as at, cast(array() as array<struct<a:int,b:int>>) as out), (a, x) -> struct(
        greatest(a.at, x.e) as at, if(x.s >= a.at, concat(a.out, array(struct(a.at as a, x.s as b))), a.out) as out), a -> a.out)"""
    clear = f"transform(array({blocks_sql('all')}), bs -> flatten(zip_with(bs, slice({ends}, 1, size(bs)), (b, at) -> {block})))[0]"
    d = d.withColumn("clear", F.expr(f"if(size(all) = 0, null, concat({clear}, array(struct(array_max(transform(all, x -> x.e)) as a, length(text) as b))))"))
    clean = f"""if(size(all) = 0, text, transform(array(struct({chunks_sql('text')} as t, clear as cuts)), v ->
        array_join(transform(v.cuts, x -> {cut_sql("v.t", "x.a", "x.b")}), '{mark}'))[0])"""
    return d.select(*[F.expr(clean).alias("text") if c == "text" else d[c] for c in columns])
