"""Personal data by weak supervision, with built-in functions only.

Candidate spans come from patterns: the four base kinds, which are always kept once valid, and loose kinds, whose
patterns also take long words, counts and other numbers. Regex, gazetteer and context labelers vote on each loose
candidate or abstain. Votes are counted by pattern (kind, votes, features), of which there is a fixed number;
expectation-maximisation over these counts estimates each labeler's reliability and each pattern's posterior, and a
logistic span classifier is trained on the posteriors. Its weights become an SQL expression that accepts or refuses.
Base spans are certain anyway and take no part in the estimates.

Texts are searched once: spans, which are few, are written to the shared folder, and both the fit and the result come
from there. Places follow from lengths: a pattern's matches and the pieces between them are taken in one pass each, so a
text of any length costs linear time. Optional separators, which would need nested repetition, are first turned into a
private character of the same length; no pattern repeats a group without bound.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnweave.llm._session import cut, pinned

#: Kinds in the order that breaks ties of position; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "credential", "key", "id_number", "local_phone")
BASE = KINDS[:4]

#: A private character that stands for a separator while a pattern is matched.
_MARK = "\ue000"
_LOCAL = rf"A-Za-z0-9._%+{_MARK}-"
_SECRETS = "password|passwd|secret|token|api[_-]?key"
#: Column that a kind is looked for in, and its pattern.
PATTERNS = {
    "email": ("_dotted", rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++{_MARK}[A-Za-z0-9{_MARK}-]++"),
    "ip": ("_plain", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": ("_spaced", rf"(?<![0-9{_MARK}])(?:[0-9]{_MARK}?){{13,18}}[0-9](?![0-9{_MARK}])"),
    "phone": ("_plain", r"\+[0-9][ ().0-9-]+[0-9]"),
    "credential": ("_worded", rf"""(?<=(?i:{_SECRETS}) {{0,2}}[=:] {{0,2}}["']?)[^\x09-\x0D "',;]{{6,}}+"""),
    "key": ("_running", r"(?<![A-Za-z0-9])[A-Za-z0-9]{20,}+"),
    "id_number": ("_plain", r"(?<![0-9A-Za-z-])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[0-9]{9,19})(?![0-9A-Za-z-])"),
    "local_phone": ("_plain", r"(?<![0-9+(])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"),
}
#: What makes a span likelier or not. Beginnings of service keys, lengths of digests in hexadecimal, values
#: that stand for a secret in manuals, words before a span.
KEY_BEGINNINGS = "AKIA|ASIA|AIza|ghp|gho|sk|pk|xox"
DIGEST_LENGTHS = "32|40|56|64|96|128"
PLACEHOLDERS = "changeme|change_me|example|password|placeholder|redacted|required|secret|string|undefined|your.*|x+|[*]+|[.]+|<.*|[$][{].*"
FOR_WORDS = "account|address|card|call|contact|fax|host|iban|ip|key|login|mail|passport|passwd|password|pay|phone|secret|ssn|tel|token|visa"
AGAINST_WORDS = "chapter|commit|doi|figure|isbn|issn|item|order|page|part|section|sha|table|version"

_BLOCK = 128


def _located(kind: str) -> Column:
    """The matches of a kind with the text before and after each, from ``_pieces``, the text between the matches."""
    column, pattern = PATTERNS[kind]
    found, pieces = F.regexp_extract_all(column, F.lit(pattern), F.lit(0)), F.col("_pieces")
    return F.transform(
        found,
        lambda m, i: F.struct(m.alias("text"), F.get(pieces, i).alias("gap"), F.get(pieces, i + 1).alias("next")),
    )


def _placed(name: str, kind: str) -> Column:
    # sums of all lengths before a match: of whole blocks of matches, then within its block
    return F.expr(
        f"""transform({name}, (m, i) -> named_struct(
              'start', cast(_sum(i) - char_length(m.text) AS int), 'kind', {KINDS.index(kind)}, 'end', cast(_sum(i) AS int),
              'text', translate(m.text, '{_MARK}', '{"." if kind == "email" else " "}'), 'left', right(m.gap, 24), 'right', left(m.next, 1)))""".replace(
            "_sum(i)",
            f"(aggregate(slice({name}_blocks, 1, i div {_BLOCK}), 0L, (a, x) -> a + x)"
            f" + aggregate(slice({name}, (i div {_BLOCK}) * {_BLOCK} + 1, i % {_BLOCK} + 1), 0L, (a, x) -> a + char_length(x.gap) + char_length(x.text)))",
        )
    )


def _meets(spans: str) -> str:
    """SQL: whether a span m shares characters with one of ``spans``, which are sorted and apart from each other.

    The last of them that starts before m ends reaches furthest of those; it is found by halving.
    """
    step = f"shiftright(shiftleft(1, length(bin(size({spans})))), k)"
    before = f"aggregate(sequence(1, length(bin(size({spans})))), 0, (n, k) -> if(n + {step} <= size({spans}) AND get({spans}, n + {step} - 1).start < m.end, n + {step}, n))"
    return f"get(transform(array({before}), n -> n > 0 AND get({spans}, n - 1).end > m.start), 0)"


_DIGITS = "regexp_replace(m.text, '[^0-9]', '')"
_VALID = {
    "email": "true",
    "ip": r"m.text rlike '^(0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})([.]|$)){4}$'",
    "card": f"luhn_check({_DIGITS})",
    "phone": f"length({_DIGITS}) BETWEEN 10 AND 15",
    "credential": "true",
    "key": "true",
    "id_number": "true",
    "local_phone": "true",
}

_MIXED = "(m.text rlike '[A-Za-z]' AND m.text rlike '[0-9].*[0-9].*[0-9]')"
_DISTINCT = "size(array_distinct(split(m.text, '')))"
_BEFORE = "lower(m.left) rlike '(?:^|[^a-z])({words})[^a-z0-9]{{0,6}}$'"
_NAMED, _DENIED = _BEFORE.format(words=FOR_WORDS), _BEFORE.format(words=AGAINST_WORDS)
#: Labelers of the loose kinds: name and SQL over a candidate m with its kind; 1 for, 0 against, null abstains.
LABELERS = (
    ("regex_shape", f"CASE m.kind WHEN 4 THEN if(m.text rlike '[^A-Za-z]', 1, 0) WHEN 5 THEN if({_MIXED}, 1, 0) WHEN 6 THEN if(m.text rlike '^(?!000|666|9)[0-9]{{3}}-(?!00)[0-9]{{2}}-(?!0000)', 1, 0) ELSE if({_DIGITS} rlike '^[2-9]..[2-9]', 1, 0) END"),
    ("regex_variety", f"CASE WHEN m.kind IN (4, 5) THEN if({_DISTINCT} >= 8, 1, 0) WHEN {_DISTINCT} < 4 THEN 0 END"),
    ("gazetteer_forms", f"CASE WHEN m.kind IN (4, 5) AND (m.text rlike '^({KEY_BEGINNINGS})[A-Z0-9_-]' OR m.text rlike '^[0-9a-f]+$' AND length(m.text) IN ({DIGEST_LENGTHS.replace('|', ', ')})) THEN 1 WHEN m.kind = 5 AND m.text rlike '^([A-Za-z]?[a-z]+|[0-9]+)$' THEN 0 END"),
    ("gazetteer_placeholders", f"CASE WHEN m.kind = 4 AND m.text rlike '(?i)^({PLACEHOLDERS})$' THEN 0 END"),
    ("context_for", f"if({_NAMED}, 1, if(m.kind IN (5, 6), 0, null))"),
    ("context_against", f"if({_DENIED}, 0, null)"),
)
#: Features of the classifier besides kind: an SQL condition over a candidate m.
FEATURES = (
    ("long", "length(m.text) >= 16"),
    ("mostly_digits", f"2 * length({_DIGITS}) >= length(m.text)"),
    ("mixed", _MIXED),
    ("dashed", "m.text rlike '[0-9][ .)-]+[0-9]'"),
    ("named", _NAMED),
    ("denied", _DENIED),
    ("placeholder", f"m.text rlike '(?i)^({PLACEHOLDERS})$'"),
    ("varied", f"{_DISTINCT} >= 8"),
)


def candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The input with ``_base`` and ``_more``: valid spans of the base kinds, and candidates of the others.

    Each is an array of (start, kind, end, text, left, right), ordered. Credentials and keys are looked for in every
    text, the other kinds, which need a digit or ``@``, in texts that have one. Loose candidates overlap neither base
    spans nor loose ones of an earlier kind.
    """
    plain = F.replace(F.coalesce(F.col(text_col), F.lit("")), F.lit(_MARK), F.lit("\ufffd"))
    f = docs.withColumn("_plain", F.when(plain.rlike("[0-9@]"), plain))
    f = f.withColumn("_worded", F.when(plain.rlike(f"(?i)(?:{_SECRETS}) {{0,2}}[=:]"), plain))
    f = f.withColumn("_running", F.when(plain.rlike("[A-Za-z0-9]{20}"), plain))
    f = f.withColumn("_dotted", F.when(F.contains("_plain", F.lit("@")), F.regexp_replace("_plain", r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", _MARK)))
    f = f.withColumn("_spaced", F.regexp_replace("_plain", r"(?<=[0-9])[ -](?=[0-9])", _MARK))
    for kind in KINDS:
        # a column of its own: within the lambda the text would be cut anew for each match
        f = f.withColumn("_pieces", pinned(F.split(PATTERNS[kind][0], PATTERNS[kind][1], -1)))
        f = f.withColumn(f"_{kind}", pinned(_located(kind)))
        blocks = f"CASE WHEN size(_{kind}) = 0 THEN cast(array() AS array<bigint>) ELSE transform(sequence(0, (size(_{kind}) - 1) div {_BLOCK}), b -> aggregate(slice(_{kind}, cast(b * {_BLOCK} + 1 AS int), {_BLOCK}), 0L, (a, x) -> a + char_length(x.gap) + char_length(x.text))) END"
        f = f.withColumn(f"_{kind}_blocks", pinned(F.expr(blocks)))
    empty = "cast(array() AS array<struct<start: int, kind: int, end: int, text: string, left: string, right: string>>)"
    for kind in KINDS:
        f = f.withColumn(f"_{kind}", F.coalesce(_placed(f"_{kind}", kind), F.expr(empty)))
        f = f.withColumn(f"_{kind}", pinned(F.expr(f"filter(_{kind}, m -> {_VALID[kind]})")))
    f = f.withColumn("_base", F.array_sort(F.concat(*(f"_{k}" for k in BASE))))
    loose = KINDS[len(BASE) :]
    clear = [F.expr(f"filter(_{kind}, m -> NOT ({' OR '.join(_meets(f'_{k}') for k in KINDS[: KINDS.index(kind)])}))") for kind in loose]
    f = f.withColumn("_more", F.array_sort(F.concat(*clear)))
    return f.drop("_pieces", "_plain", "_worded", "_running", "_dotted", "_spaced", *(f"_{k}" for k in KINDS), *(f"_{k}_blocks" for k in KINDS))


def votes(found: DataFrame) -> DataFrame:
    """How many loose candidates have each pattern of kind, votes and features: a table of bounded size."""
    each = found.select(F.explode("_more").alias("m"))
    each = each.select(F.col("m.kind").alias("kind"), *(F.expr(sql).alias(n) for n, sql in LABELERS), *(F.expr(sql).cast("int").alias(f"f_{n}") for n, sql in FEATURES))
    return each.groupBy(*each.columns).agg(F.count("*").alias("n"))


def fit_labelers(patterns: list[tuple[list[int | None], int]], rounds: int = 50) -> tuple[float, list[tuple[float, float]], list[float]]:
    """Expectation-maximisation over (votes, count): share of true spans, each labeler's (P(1 | true), P(1 | false)), and
    each pattern's posterior. Starts from majority votes. Five pseudo-counts a cell say that a labeler is right four
    times in five, for as long as the counts do not say otherwise; a labeler may turn out to be worse than a coin."""
    posterior = []
    for cast, _ in patterns:
        given = [v for v in cast if v is not None]
        posterior.append((sum(given) + 1) / (len(given) + 2))
    n_labelers = len(patterns[0][0]) if patterns else 0
    share, rates = 0.5, [(0.8, 0.2)] * n_labelers
    for _ in range(rounds):
        total = sum(n for _, n in patterns)
        share = (sum(p * n for p, (_, n) in zip(posterior, patterns)) + 1) / (total + 2)
        rates = []
        for j in range(n_labelers):
            t1 = t = f1 = f = 0.0
            for p, (cast, n) in zip(posterior, patterns):
                if cast[j] is not None:
                    t, f = t + p * n, f + (1 - p) * n
                    t1, f1 = t1 + p * n * cast[j], f1 + (1 - p) * n * cast[j]
            rates.append(((t1 + 4) / (t + 5), (f1 + 1) / (f + 5)))
        before = posterior
        posterior = []
        for cast, _ in patterns:
            odds = math.log(share / (1 - share))
            for v, (true, false) in zip(cast, rates):
                if v is not None:
                    odds += math.log(true / false) if v else math.log((1 - true) / (1 - false))
            posterior.append(1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))))
        if max((abs(a - b) for a, b in zip(before, posterior)), default=0) < 1e-6:
            break
    return share, rates, posterior


def fit_classifier(rows: list[tuple[list[int], float, float]], steps: int = 200, decay: float = 0.01) -> list[float]:
    """Logistic regression by full-batch gradient steps on (0/1 features, target, count); the last weight is the bias."""
    if not rows:
        return []
    width = len(rows[0][0]) + 1
    weights, total = [0.0] * width, sum(n for _, _, n in rows)
    for _ in range(steps):
        gradient = [decay * w for w in weights]
        for x, target, n in rows:
            z = weights[-1] + sum(w for w, v in zip(weights, x) if v)
            error = (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - target) * n / total
            for i, v in enumerate((*x, 1)):
                if v:
                    gradient[i] += error
        weights = [w - 2.0 * g for w, g in zip(weights, gradient)]
    return weights


def train(found: DataFrame) -> list[float]:
    """Classifier weights: one per loose kind, one per feature, the bias. Every candidate of the table is counted; kinds
    have equal weight, so that a rare one is learned as well as a common one."""
    rows = votes(found).collect()  # at most kinds x 3 ** labelers x 2 ** features rows
    rows.sort(key=lambda r: tuple(-1 if v is None else v for v in r))
    n = len(LABELERS)
    _, _, posterior = fit_labelers([(list(r[1 : n + 1]), r["n"]) for r in rows])
    loose = range(len(BASE), len(KINDS))
    of_kind = {k: sum(r["n"] for r in rows if r["kind"] == k) for k in loose}
    return fit_classifier([([int(r["kind"] == k) for k in loose] + [int(bool(v)) for v in r[n + 1 : -1]], p, r["n"] / of_kind[r["kind"]]) for r, p in zip(rows, posterior)])


def accepted(weights: list[float], threshold: float = 0.5) -> str:
    """SQL over a loose candidate m: whether the classifier takes it."""
    loose = len(KINDS) - len(BASE)
    z = f"{weights[-1]}D + CASE m.kind " + " ".join(f"WHEN {len(BASE) + k} THEN {w}D" for k, w in enumerate(weights[:loose])) + " END"
    z += "".join(f" + IF({sql}, {w}D, 0D)" for (_, sql), w in zip(FEATURES, weights[loose:]))
    return f"1 / (1 + exp(-({z}))) >= {threshold}D"


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per input row: ``id_col, base, spans``, arrays of (start, kind, end, text) by start, then kind.

    Places are code points, end exclusive. Base spans are the valid matches of e-mail address, IP address, payment card
    and telephone patterns; ``spans`` has them and the loose candidates that the classifier takes, none of which
    overlaps another. A null text counts as empty and has no spans. Repeated rows are searched each, and each counts for
    the fit. With no candidates nothing is trained; an empty table gives an empty result. Other columns are ignored.
    """
    found = candidates(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), "_text")
    # looked up where the pattern may have seen another character than the text has
    own = lambda m: F.when(m["kind"].isin(KINDS.index("card"), KINDS.index("credential")), F.substr("_text", m["start"] + 1, m["end"] - m["start"])).otherwise(m["text"])
    whole = lambda spans: pinned(F.transform(spans, lambda m: F.struct(m["start"].alias("start"), m["kind"].alias("kind"), m["end"].alias("end"), own(m).alias("text"), m["left"].alias("left"), m["right"].alias("right"))))
    found = cut(found.select("_id", whole("_base").alias("_base"), whole("_more").alias("_more")))
    weights = train(found)
    added = F.expr(f"filter(_more, m -> {accepted(weights, threshold)})") if weights else F.col("_more")
    bare = lambda spans: F.transform(spans, lambda m: F.struct(m["start"].alias("start"), m["kind"].alias("kind"), m["end"].alias("end"), m["text"].alias("text")))
    return found.select(F.col("_id").alias(id_col), pinned(bare(F.col("_base"))).alias("base"), pinned(bare(F.array_sort(F.concat("_base", added)))).alias("spans"))


def written(spans: str) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda m: F.concat_ws(":", F.get(names, m["kind"]), m["start"], m["end"])), ",")
