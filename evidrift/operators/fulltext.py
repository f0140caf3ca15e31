"""Full-text search in English: lexemes with positions, web-search queries, and rank by cover density.

A lexeme is a run of letters and digits, lower-cased, that is no stop word, reduced by the Snowball stemmer for English (Porter2, as published). Stop words count as positions. A query
is words that all must occur, phrases in quotes, `or` between alternatives, and words after a minus that must not occur. The rank sums a tenth over the noise of every shortest stretch
of a text that satisfies the query, as cover density ranking with equal weights does.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# English stop words.
STOP = frozenset(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that these those am is are was "
    "were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during before after above below to from up down in out on off "
    "over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now".split()
)
# Words that the stemmer treats by themselves, and its suffix lists.
EXCEPTIONS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
KEPT = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
STEP2 = [("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"),
         ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble")]
STEP3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ical", "ic"), ("ness", ""), ("ful", "")]
STEP4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic"]
_V = "aeiouy"
POSTINGS = 20_000  # rows of an index that a task holds before it passes them on


def _regions(w: str) -> tuple[int, int]:
    """Where the regions after the first, and after the second, consonant that follows a vowel begin."""
    def after(at):
        m = re.compile(r"[aeiouy][^aeiouy]").search(w, at)
        return m.end() if m else len(w)

    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = after(0) if r1 is None else r1
    return r1, after(r1)


def _short_end(w: str) -> bool:
    return bool(re.search(r"[^aeiouy][aeiouy][^aeiouywxY]$", w)) or bool(re.fullmatch(r"[aeiouy][^aeiouy]", w))


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    w = word
    if len(w) <= 2:
        return w
    if w in EXCEPTIONS:
        return EXCEPTIONS[w]
    w = re.sub(r"(^|[aeiouy])y", r"\1Y", w)
    r1, r2 = _regions(w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(r"[aeiouy]", w[:-2]):
        w = w[:-1]
    if w in KEPT:
        return w.lower()
    for end in ("eedly", "eed"):
        if w.endswith(end):
            if len(w) - len(end) >= r1:
                w = w[: -len(end)] + "ee"
            break
    else:
        for end in ("ingly", "edly", "ing", "ed"):
            if w.endswith(end):
                if re.search(r"[aeiouy]", w[: -len(end)]):
                    w = w[: -len(end)]
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", w):
                        w = w[:-1]
                    elif r1 >= len(w) and _short_end(w):
                        w += "e"
                break
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _V:
        w = w[:-1] + "i"
    for end, to in STEP2:
        if w.endswith(end):
            if len(w) - len(end) >= r1:
                w = w[: -len(end)] + to
            break
    else:
        if w.endswith("ogi") and len(w) - 3 >= r1 and w[-4:-3] == "l":
            w = w[:-1]
        elif w.endswith("li") and len(w) - 2 >= r1 and w[-3:-2] in tuple("cdeghkmnrt"):
            w = w[:-2]
    for end, to in STEP3:
        if w.endswith(end):
            if len(w) - len(end) >= r1:
                w = w[: -len(end)] + to
            break
    else:
        if w.endswith("ative") and len(w) - 5 >= r2:
            w = w[:-5]
    for end in STEP4:
        if w.endswith(end):
            if len(w) - len(end) >= r2:
                w = w[: -len(end)]
            break
    else:
        if w.endswith("ion") and len(w) - 3 >= r2 and w[-4:-3] in ("s", "t"):
            w = w[:-3]
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_end(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


def lexemes(text: str) -> list[tuple[str, int]]:
    """Lexemes with their positions, from 1."""
    words = re.findall(r"[^\W_]+", text.lower())
    return [(stem(w), i) for i, w in enumerate(words, 1) if w not in STOP]


def parse(query: str) -> list[tuple[list[list[tuple[str, int]]], list[list[tuple[str, int]]]]]:
    """Alternatives of a web-search query: what must occur and what must not, each a phrase of lexemes with their places in it."""
    out, wanted, barred = [], [], []
    for minus, phrase, word in re.findall(r"(-?)\"([^\"]*)\"|(-?[^\s\"]+)", query) and [(m.group(1) or "", m.group(2), m.group(3)) for m in re.finditer(r"(?:(-?)\"([^\"]*)\"|([^\s\"]+))", query)]:
        if word is not None:
            if word.lower() == "or":
                out.append((wanted, barred))
                wanted, barred = [], []
                continue
            minus, phrase = ("-", word[1:]) if word.startswith("-") else ("", word)
        own = lexemes(phrase)
        if own:
            (barred if minus else wanted).append(own)
    out.append((wanted, barred))
    return [x for x in out if x[0]]


def _holds(phrase: list[tuple[str, int]], where: dict[str, list[int]]) -> bool:
    first, at = phrase[0]
    return any(all(p + o - at in where.get(t, ()) for t, o in phrase[1:]) for p in where.get(first, ()))


def rank(query: str, where: dict[str, list[int]]) -> float:
    """The rank of a text by the positions of its lexemes; 0 if it does not match."""
    matched = [a for a in parse(query) if all(_holds(p, where) for p in a[0]) and not any(_holds(p, where) for p in a[1])]
    if not matched:
        return 0.0
    needs = [{t for p in a[0] for t, _ in p} for a in matched]
    entries = sorted((p, t) for t in set().union(*needs) for p in where.get(t, ()))
    enough = lambda own: any(n <= own for n in needs)
    total, start = 0.0, 0
    while start < len(entries):
        seen: set[str] = set()
        end = next((i for i in range(start, len(entries)) if seen.add(entries[i][1]) or enough(seen)), None)
        if end is None:
            break
        seen = set()
        begin = next(i for i in range(end, start - 1, -1) if seen.add(entries[i][1]) or enough(seen))
        noise = (entries[end][0] - entries[begin][0]) - (end - begin)
        total += 0.1 / (1 + (noise if noise >= 0 else (end - begin) // 2))
        start = begin + 1
    return total


def postings(chunks: DataFrame) -> DataFrame:
    """chunk_id, lexeme, positions of chunks (chunk_id, text): an index to be stored by lexeme."""
    def index(batches):
        frame = lambda rows: pd.DataFrame(rows, columns=["chunk_id", "lexeme", "positions"])
        rows = []
        for b in batches:
            for c, text in zip(b["chunk_id"], b["text"]):
                where: dict[str, list[int]] = {}
                for t, p in lexemes(text or ""):
                    where.setdefault(t, []).append(p)
                rows += [(c, t, p) for t, p in where.items()]
                if len(rows) >= POSTINGS:
                    yield frame(rows)
                    rows = []
        if rows:
            yield frame(rows)

    kind = chunks.schema["chunk_id"].dataType.simpleString()
    return chunks.select("chunk_id", "text").mapInPandas(index, f"chunk_id {kind}, lexeme string, positions array<int>")


def search(queries: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """qid, chunk_id, score, rank: the k best matches of each query (qid, query) by cover density, equals by chunk_id. Only postings of the queries' lexemes are
    joined, by a broadcast of few queries' lexemes or else with these as the side that is held for each lexeme; the positions of one text and query meet in one small group, and
    texts that lack a lexeme of every alternative are passed over before they are ranked."""
    from .retrieval import small

    @F.pandas_udf("array<string>")
    def asked(q: pd.Series) -> pd.Series:
        return q.map(lambda x: sorted({t for a in parse(x or "") for part in a for p in part for t, _ in p}))

    @F.pandas_udf("array<array<string>>")
    def needed(q: pd.Series) -> pd.Series:
        return q.map(lambda x: [sorted({t for p in a[0] for t, _ in p}) for a in parse(x or "")])

    @F.pandas_udf("double")
    def ranked(q: pd.Series, names: pd.Series, places: pd.Series) -> pd.Series:
        return pd.Series([rank(x, dict(zip(n, (list(p) for p in where)))) for x, n, where in zip(q, names, places)], dtype="float64")

    wanted = queries.select("qid", F.explode(asked("query")).alias("lexeme")).distinct()
    met = index.join(small(wanted), "lexeme").groupBy("qid", "chunk_id").agg(F.collect_list(F.struct("lexeme", "positions")).alias("found"))
    met = met.join(small(queries.select("qid", "query", needed("query").alias("needed"))), "qid").where(F.exists("needed", lambda a: F.size(F.array_except(a, F.col("found.lexeme"))) == 0))
    scored = met.select("qid", "chunk_id", ranked("query", "found.lexeme", "found.positions").alias("score")).where("score > 0")
    w = W.partitionBy("qid").orderBy(F.round("score", 9).desc(), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
