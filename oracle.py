"""The registered queries as SQL for DuckDB, under the same names and columns."""

from __future__ import annotations

# Nothing here is taken from the library, so that a wrong value there shows.

# ASCII punctuation.
PUNCTUATION = "".join(map(chr, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]))

# The English stop words of Spark ML.
STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her
hers herself it its itself they them their theirs themselves what which who whom this that these
those am is are was were be been being have has had having do does did doing a an the and but if or
because as until while of at by for with about against between into through during before after
above below to from up down in out on off over under again further then once here there when where
why how all any both each few more most other some such no nor not only own same so than too very s
t can will just don should now i'll you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd
they'd i'm you're he's she's it's we're they're i've we've you've they've isn't aren't wasn't
weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't shan't shouldn't mustn't can't
couldn't cannot could here's how's let's ought that's there's what's when's where's who's why's
would
""".split()

# Fixed values of Porter's stemmer. A word is a run of consonants, then vowels and consonants in turn;
# y is a vowel after a consonant.
MEASURE_OPEN = "^([^aeiou][^aeiouy]*[aeiouy]|[aeiou])[aeiou]*"
HAS_VOWEL = "^([^aeiou][^aeiouy]*[aeiouy]|[aeiou])"
POSITIVE = MEASURE_OPEN + "[^aeiou]"
ABOVE_ONE = MEASURE_OPEN + "[^aeiou][^aeiouy]*[aeiouy][aeiou]*[^aeiou]"
JUST_ONE = MEASURE_OPEN + "[^aeiou][^aeiouy]*([aeiouy][aeiou]*)?$"
CONSONANT = "((^|[aeiou])y(yy)*|[^aeiouy]yy(yy)*|[^aeiouy])"
ENDS_CONSONANT = CONSONANT + "$"
SHORT_END = CONSONANT + "[aeiouy][^aeiouwxy]$|^[aeiou][^aeiou]$"
DOUBLE_SUFFIXES = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble",
    "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate",
    "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al",
    "iviti": "ive", "biliti": "ble", "fulli": "ful",
}
ADJECTIVE_SUFFIXES = {
    "icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": "",
}
LAST_SUFFIXES = "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize".split()
IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news",
    "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing",
    "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed",
    "exceed": "exceed", "succeed": "succeed",
}

# Noun endings and those of the base form.
NOUN_ENDINGS = {
    "s": "", "ses": "s", "ves": "f", "xes": "x", "zes": "z", "ches": "ch", "shes": "sh", "men": "man",
    "ies": "y",
}

# English number names.
SMALL = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen "
    "sixteen seventeen eighteen nineteen"
).split()
ROUND_TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
BELOW_HUNDRED = [
    SMALL[n] if n < 20 else ROUND_TENS[n // 10 - 2] + ("-" + SMALL[n % 10] if n % 10 else "") for n in range(100)
]
GROUP_NAMES = ["", " thousand", " million", " billion"]

# Fixed values of the sentiment rules, with the words that the query adds.
NEGATIONS = """
aint arent cannot cant couldnt darent didnt doesnt ain't aren't can't couldn't daren't didn't doesn't
dont hadnt hasnt havent isnt mightnt mustnt neither don't hadn't hasn't haven't isn't mightn't
mustn't neednt needn't never none nope nor not nothing nowhere oughtnt shant shouldnt uhuh wasnt
werent oughtn't shan't shouldn't uh-uh wasn't weren't without wont wouldnt won't wouldn't rarely
seldom despite nicht pas no
""".split()
STRONGER = """
absolutely amazingly awfully completely considerably decidedly deeply effing enormously entirely
especially exceptionally extremely fabulously flipping flippin fricking frickin frigging friggin
fully fucking greatly hella highly hugely incredibly intensely majorly more most particularly purely
quite really remarkably so substantially thoroughly totally tremendously uber unbelievably unusually
utterly very this der une
""".split()
WEAKER = """
almost barely hardly kinda kindof kind-of less little marginally occasionally partly scarcely slightly
somewhat sorta sortof sort-of from sich por
""".split()
WEAKER_PAIRS = ["just enough", "kind of", "sort of"]
IDIOMS = {
    "the shit": 3.0, "the bomb": 3.0, "bad ass": 1.5, "yeah right": -2.0, "cut the mustard": 2.0,
    "kiss of death": -1.5, "hand to mouth": -2.0,
}
# A word of two characters or more without punctuation, and one mark at one end.
ONE_MARK = r"""([.!?,;:'"-]|!!|!!!|\?\?|\?\?\?|\?!\?|!\?!|\?!\?!|!\?!\?)"""
BARE = r"[^!-/:-@\[-`{-~]{2,}"
MARKED_WORD = f"^({ONE_MARK}{BARE}|{BARE}{ONE_MARK})$"


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def in_list(words) -> str:
    return "(" + ", ".join(quote(w) for w in words) + ")"


P = quote(PUNCTUATION)
SPACE = r"[\t-\r\x1C-\x20\x{85}\p{Z}]"
STOP = in_list(STOP_WORDS)
CLEAN = (
    f"regexp_replace(regexp_replace(translate(text, {P}, ''), '[^\\x00-\\x7F]', '', 'g'), "
    "'\\p{Nd}+', '', 'g')"
)


def tokens(c: str) -> str:
    body = f"rtrim({c}, E' \\t\\n\\x0b\\f\\r')"
    return (
        f"CASE WHEN {c} <> '' AND {body} = '' THEN []::VARCHAR[] "
        f"ELSE list_transform(regexp_split_to_array({body}, '[ \\t-\\r]'), lambda w: lower(w)) END"
    )


def rows(c: str = "text", source: str = "documents", key: str = "doc_id") -> str:
    """Tokens with positions, (doc_id, pos, w)."""
    return (
        f"SELECT {key}, generate_subscripts(a, 1) - 1 AS pos, unnest(a) AS w "
        f"FROM (SELECT {key}, {tokens(c)} AS a FROM {source})"
    )


def rebuilt(kept: str, out: str) -> str:
    """Text of every document from the rows that are left."""
    return (
        f"SELECT d.doc_id, coalesce(k.t, '') AS {out} FROM documents d LEFT JOIN "
        f"(SELECT doc_id, string_agg(w, ' ' ORDER BY pos) AS t FROM ({kept}) GROUP BY doc_id) k "
        "ON d.doc_id = k.doc_id"
    )


def listed(expression: str, out: str, table: str = "documents", key: str = "doc_id") -> str:
    return (
        f"SELECT {key}, array_to_string(a, ' ') AS {out}, len(a) AS n "
        f"FROM (SELECT {key}, {expression} AS a FROM {table})"
    )


def scalar(expression: str, out: str, table: str = "documents", key: str = "doc_id") -> str:
    return f"SELECT {key}, {expression} AS {out} FROM {table}"


# ---- stems ---------------------------------------------------------------


def cut(n: int) -> str:
    return f"substring(w, 1, length(w) - {n})"


def fits(n: int, shape: str) -> str:
    return f"regexp_matches({cut(n)}, {quote(shape)})"


def suffix_case(rules_: list[tuple[str, str, str]]) -> str:
    whens = " ".join(
        f"WHEN ends_with(w, '{s}') THEN CASE WHEN {test} THEN {value} ELSE w END"
        for s, value, test in rules_
    )
    return f"CASE {whens} ELSE w END"


def swaps(table, shape: str) -> list[tuple[str, str, str]]:
    return [(s, f"{cut(len(s))} || '{r}'", fits(len(s), shape)) for s, r in table]


def stem_steps() -> list[str]:
    """The stemmer as one expression of ``w`` per step; a cut -ed or -ing is marked by a
    space at the end, which tokens never hold."""
    short = f"regexp_matches(s, {quote(SHORT_END)})"
    mend = f"""CASE WHEN NOT ends_with(w, ' ') THEN w ELSE (SELECT CASE
        WHEN right(s, 2) IN ('at', 'bl', 'iz') THEN s || 'e'
        WHEN length(s) > 1 AND right(s, 1) = left(right(s, 2), 1)
             AND regexp_matches(s, {quote(ENDS_CONSONANT)})
        THEN CASE WHEN right(s, 1) IN ('l', 's', 'z') THEN s
                  ELSE substring(s, 1, length(s) - 1) END
        WHEN regexp_matches(s, {quote(JUST_ONE)}) AND ({short}) THEN s || 'e'
        ELSE s END FROM (SELECT rtrim(w) AS s)) END"""
    final_e = (
        f"{fits(1, ABOVE_ONE)} OR ({fits(1, JUST_ONE)} "
        f"AND NOT {fits(1, SHORT_END)})"
    )
    return [
        f"""CASE WHEN ends_with(w, 'sses') THEN {cut(2)}
            WHEN ends_with(w, 'ies') THEN CASE WHEN length(w) = 4 THEN {cut(1)} ELSE {cut(2)} END
            WHEN ends_with(w, 'ss') THEN w WHEN ends_with(w, 's') THEN {cut(1)} ELSE w END""",
        f"""CASE WHEN ends_with(w, 'ied') THEN CASE WHEN length(w) = 4 THEN {cut(1)} ELSE {cut(2)} END
            WHEN ends_with(w, 'eed') THEN CASE WHEN {fits(3, POSITIVE)} THEN {cut(1)} ELSE w END
            WHEN ends_with(w, 'ed') THEN CASE WHEN {fits(2, HAS_VOWEL)} THEN {cut(2)} || ' ' ELSE w END
            WHEN ends_with(w, 'ing') THEN CASE WHEN {fits(3, HAS_VOWEL)} THEN {cut(3)} || ' ' ELSE w END
            ELSE w END""",
        mend,
        suffix_case([("y", f"{cut(1)} || 'i'", f"length(w) > 2 AND {fits(1, ENDS_CONSONANT)}")]),
        suffix_case(swaps([("alli", "al")], POSITIVE)),
        suffix_case(swaps(DOUBLE_SUFFIXES.items(), POSITIVE) + [("logi", cut(1), fits(3, POSITIVE))]),
        suffix_case(swaps(ADJECTIVE_SUFFIXES.items(), POSITIVE)),
        suffix_case(
            swaps([(s, "") for s in LAST_SUFFIXES], ABOVE_ONE)
            + [("ion", cut(3), f"{fits(3, '[st]$')} AND {fits(3, ABOVE_ONE)}")]
        ),
        suffix_case([("e", cut(1), final_e)]),
        suffix_case([("ll", cut(1), fits(1, ABOVE_ONE))]),
    ]


def stems_of(terms: str) -> str:
    """(term, stem) of a query of terms ``w``."""
    inner = f"SELECT w AS term, w FROM ({terms})"
    for step in stem_steps():
        inner = f"SELECT term, {step} AS w FROM ({inner})"
    irregular = " ".join(f"WHEN term = '{w}' THEN '{f}'" for w, f in IRREGULAR.items())
    return (
        f"SELECT term, CASE WHEN length(term) <= 2 THEN term {irregular} ELSE w END AS stem "
        f"FROM ({inner})"
    )


STEMS = f"""
WITH r AS ({rows(CLEAN)}), s AS ({stems_of('SELECT DISTINCT w FROM r')}),
k AS (SELECT doc_id, string_agg(stem, ' ' ORDER BY pos) AS t, count(*) AS n
      FROM r JOIN s ON r.w = s.term WHERE length(stem) >= 3 GROUP BY doc_id)
SELECT d.doc_id, coalesce(t, '') AS stems, coalesce(n, 0) AS n
FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id"""

# ---- lemmas, spelling, translation ----------------------------------------

COMMON = f"SELECT w AS word, count(*) AS freq FROM ({rows()}) GROUP BY w HAVING count(*) >= 20"
ENDINGS = ", ".join(f"('{f}', '{w}', {i})" for i, (f, w) in enumerate(NOUN_ENDINGS.items(), 1))


def lemmas_of(terms: str) -> str:
    """(term, lemma) of a query of terms ``w``; needs the dictionary ``words``."""
    return f"""SELECT term, lemma FROM (
        SELECT c.w AS term, c.base AS lemma,
               row_number() OVER (PARTITION BY c.w ORDER BY length(c.base), c.i) AS rn
        FROM (SELECT w, w AS base, 0 AS i FROM ({terms})
              UNION ALL
              SELECT w, left(w, length(w) - length(e.form)) || e.word, e.i
              FROM ({terms}) JOIN (VALUES {ENDINGS}) e(form, word, i) ON suffix(w, e.form)) c
        JOIN words ON words.word = c.base) WHERE rn = 1"""


LEMMATIZE = f"""
WITH r AS ({rows()}), words AS ({COMMON}),
l AS ({lemmas_of('SELECT DISTINCT w FROM r')}),
k AS (SELECT doc_id, pos, coalesce(lemma, w) AS w FROM r LEFT JOIN l ON r.w = l.term)
{rebuilt('SELECT * FROM k WHERE length(w) >= 3', 'lemmas')}"""

NORMALIZE = f"""
WITH words AS ({COMMON}),
r AS ({rows(CLEAN)}),
kept AS (SELECT * FROM r WHERE w NOT IN {STOP}),
s AS ({stems_of('SELECT DISTINCT w FROM kept')}),
st AS (SELECT doc_id, pos, stem AS w FROM kept JOIN s ON kept.w = s.term WHERE length(stem) >= 3),
l AS ({lemmas_of('SELECT DISTINCT w FROM st')}),
lm AS (SELECT doc_id, pos, coalesce(lemma, w) AS w FROM st LEFT JOIN l ON st.w = l.term),
a AS (SELECT doc_id, string_agg(w, ' ' ORDER BY pos) AS t FROM r GROUP BY doc_id),
b AS (SELECT doc_id, string_agg(w, ' ' ORDER BY pos) AS t FROM kept GROUP BY doc_id),
c AS (SELECT doc_id, string_agg(w, ' ' ORDER BY pos) AS t FROM st GROUP BY doc_id),
e AS (SELECT doc_id, string_agg(w, ' ' ORDER BY pos) AS t FROM lm WHERE length(w) >= 3 GROUP BY doc_id)
SELECT d.doc_id, translate(text, {P}, '') AS no_punct,
  regexp_replace(translate(text, {P}, ''), '[^\\x00-\\x7F]', '', 'g') AS ascii,
  {CLEAN} AS no_digits, coalesce(a.t, '') AS tokens, coalesce(b.t, '') AS no_stop,
  coalesce(c.t, '') AS stems, coalesce(e.t, '') AS lemmas
FROM documents d LEFT JOIN a USING (doc_id) LEFT JOIN b USING (doc_id)
LEFT JOIN c USING (doc_id) LEFT JOIN e USING (doc_id)"""

SHORTER = (
    "unnest(list_distinct(list_concat([w], list_transform(range(1, length(w) + 1), "
    "lambda i: left(w, i - 1) || substring(w, i + 1)))))"
)
# Words that share a form are one edit apart if one is longer by a character, or if they differ
# in one place: the database's own distance counts bytes.
SPELL = f"""
WITH r AS ({rows()}), words AS ({COMMON}),
unknown AS (SELECT DISTINCT w FROM r WHERE regexp_matches(w, '\\p{{L}}')
            AND w NOT IN (SELECT word FROM words)),
u AS (SELECT w, {SHORTER} AS form FROM unknown),
v AS (SELECT w AS word, freq, {SHORTER} AS form FROM (SELECT word AS w, freq FROM words)),
pairs AS (SELECT DISTINCT u.w, v.word, v.freq FROM u JOIN v USING (form)
          WHERE length(u.w) <> length(v.word) OR len(list_filter(range(1, length(u.w) + 1),
                lambda i: substring(u.w, i, 1) <> substring(v.word, i, 1))) = 1),
best AS (SELECT w, word FROM (SELECT *, row_number() OVER (PARTITION BY w ORDER BY freq DESC, word) AS rn
         FROM pairs) WHERE rn = 1),
k AS (SELECT doc_id, pos, coalesce(word, r.w) AS w FROM r LEFT JOIN best ON r.w = best.w)
{rebuilt('SELECT * FROM k', 'corrected')}"""

SPELL_CONTEXT = SPELL[: SPELL.index("best AS")] + f"""
n AS (SELECT *, lag(w) OVER o AS before, lead(w) OVER o AS after FROM r WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
two AS (SELECT w AS a, after AS b, count(*) AS n FROM n WHERE after IS NOT NULL GROUP BY ALL),
options AS (SELECT doc_id, pos, word, freq,
       (coalesce(l.n, 0) + 1)::HUGEINT * (coalesce(t.n, 0) + 1)::HUGEINT AS fit
     FROM n JOIN pairs ON pairs.w = n.w LEFT JOIN two l ON l.a = before AND l.b = word
     LEFT JOIN two t ON t.a = word AND t.b = after),
best AS (SELECT doc_id, pos, word FROM (SELECT *, row_number() OVER (
           PARTITION BY doc_id, pos ORDER BY fit DESC, freq DESC, word) AS rn FROM options) WHERE rn = 1),
k AS (SELECT doc_id, pos, coalesce(word, w) AS w FROM r LEFT JOIN best USING (doc_id, pos))
{rebuilt('SELECT * FROM k', 'corrected')}"""

# Places of a word one after the other, each with its best way from the start: cost, words, last cut.
SPLIT = f"""
WITH RECURSIVE r AS ({rows()}), words AS ({COMMON}),
costs AS (SELECT word, round(1000 * (ln((SELECT sum(freq) FROM words)::DOUBLE) - ln(freq::DOUBLE)))::BIGINT AS cost
          FROM words WHERE word <> ''),
unknown AS (SELECT DISTINCT w AS term FROM r WHERE regexp_matches(w, '\\p{{L}}') AND length(w) BETWEEN 2 AND 64
            AND w NOT IN (SELECT word FROM words)),
ends AS (SELECT term, unnest(range(1, length(term) + 1)) AS e FROM unknown),
pieces AS (SELECT term, s, e, substring(term, s + 1, e - s) AS word FROM (SELECT term, e, unnest(range(0, e)) AS s FROM ends)),
ways AS (SELECT term, s, e, cost FROM pieces JOIN costs USING (word) WHERE e - s < length(term)),
listed AS (SELECT term, e, list({{'s': s, 'cost': cost}} ORDER BY s) AS l FROM ways GROUP BY ALL),
grown(term, e, best) AS (
  SELECT term, 0::BIGINT, [{{'cost': 0::BIGINT, 'n': 0::BIGINT, 's': 0::BIGINT}}] FROM unknown
  UNION ALL
  SELECT term, e + 1, list_append(best, list_min(list_transform(
    list_filter(coalesce(l, []), lambda x: best[x.s + 1] IS NOT NULL),
    lambda x: {{'cost': (best[x.s + 1].cost + x.cost)::BIGINT, 'n': (best[x.s + 1].n + 1)::BIGINT, 's': x.s::BIGINT}})))
  FROM (SELECT g.term, g.e, g.best, l.l FROM grown g LEFT JOIN listed l ON l.term = g.term AND l.e = g.e + 1
        WHERE g.e < length(g.term))
),
told(term, best, place, text) AS (
  SELECT term, best, length(term)::BIGINT, '' FROM grown WHERE e = length(term) AND best[e + 1] IS NOT NULL
  UNION ALL
  SELECT term, best, best[place + 1].s,
         substring(term, best[place + 1].s + 1, place - best[place + 1].s) || CASE WHEN text = '' THEN '' ELSE ' ' || text END
  FROM told WHERE place > 0
),
cut AS (SELECT term, text FROM told WHERE place = 0),
k AS (SELECT doc_id, pos, coalesce(text, w) AS w FROM r LEFT JOIN cut ON cut.term = r.w)
{rebuilt('SELECT * FROM k', 'split')}"""

NO_PUNCT = f"translate(text, {P}, '')"
BENCHMARK_TERMS = f"SELECT DISTINCT w FROM ({rows(NO_PUNCT, 'benchmark', 'item_id')})"
TRANSLATE = f"""
WITH r AS ({rows()}), g AS ({BENCHMARK_TERMS}),
k AS (SELECT doc_id, pos, CASE WHEN g.w IS NULL THEN r.w ELSE reverse(g.w) END AS w
      FROM r LEFT JOIN g ON r.w = g.w)
{rebuilt('SELECT * FROM k', 'translated')}"""

TRANSLATE_PHRASES = f"""
WITH r AS ({rows()}), b AS (SELECT {tokens(NO_PUNCT)} AS a FROM benchmark),
runs AS (SELECT DISTINCT array_to_string(a[i:i + n - 1], ' ') AS term FROM (
    SELECT a, n, unnest(range(1, greatest(len(a) - n + 1, 1) + 1)) AS i FROM b, (VALUES (1), (2), (3)) v(n))),
g AS (SELECT trim(regexp_replace(term, ' +', ' ', 'g')) AS term, min(reverse(term)) AS target FROM runs
      WHERE trim(term) <> '' GROUP BY 1),
n AS (SELECT *, lead(w, 1) OVER o AS w1, lead(w, 2) OVER o AS w2 FROM r WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
hits AS (SELECT doc_id, pos, max(size) AS size, arg_max(target, size) AS target FROM (
    SELECT doc_id, pos, 1 AS size, target FROM n JOIN g ON g.term = w
    UNION ALL SELECT doc_id, pos, 2, target FROM n JOIN g ON g.term = w || ' ' || w1
    UNION ALL SELECT doc_id, pos, 3, target FROM n JOIN g ON g.term = w || ' ' || w1 || ' ' || w2) GROUP BY ALL),
folded AS (SELECT doc_id, list_reduce(
    list_prepend({{'pos': -1::BIGINT, 'free': 0::BIGINT, 'taken': []::BIGINT[]}},
         list({{'pos': pos::BIGINT, 'free': (pos + size)::BIGINT, 'taken': []::BIGINT[]}} ORDER BY pos)),
    lambda s, x: CASE WHEN x.pos >= s.free
         THEN {{'pos': x.pos, 'free': x.free, 'taken': list_append(s.taken, x.pos)}} ELSE s END) AS f
    FROM hits GROUP BY doc_id),
taken AS (SELECT hits.* FROM hits JOIN (SELECT doc_id, unnest(f.taken) AS pos FROM folded) USING (doc_id, pos)),
inside AS (SELECT doc_id, unnest(range(pos + 1, pos + size)) AS pos FROM taken),
k AS (SELECT r.doc_id, r.pos, coalesce(target, w) AS w FROM r LEFT JOIN taken USING (doc_id, pos)
      ANTI JOIN inside USING (doc_id, pos))
{rebuilt('SELECT * FROM k', 'translated')}"""

TOKEN_IDS = f"""
WITH r AS ({rows()}), v AS (SELECT w, row_number() OVER (ORDER BY count(*) DESC, w) - 1 AS id FROM r GROUP BY w)
{rebuilt('SELECT doc_id, pos, id::VARCHAR AS w FROM r JOIN v USING (w)', 'ids')}"""

# ---- corpus counts --------------------------------------------------------

DOC_TERMS = f"""
WITH tf AS (SELECT doc_id, w AS term, count(*) AS tf FROM ({rows()}) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
m AS (SELECT count(*) AS m FROM documents)
SELECT doc_id, term, tf, df, round(tf * ln((m + 1.0::DOUBLE) / (df + 1.0::DOUBLE)), 6) AS tfidf
FROM tf JOIN df USING (term), m"""

TOP = f"SELECT w AS term, count(*) AS n FROM ({rows()}) GROUP BY w ORDER BY n DESC, w LIMIT 20"
REMOVE_FREQUENT = f"""
WITH r AS ({rows()}), top AS ({TOP})
{rebuilt('SELECT * FROM r WHERE w NOT IN (SELECT term FROM top)', 'kept')}"""
REMOVE_RARE = f"""
WITH r AS ({rows()}), often AS (SELECT w FROM r GROUP BY w HAVING count(*) >= 3)
{rebuilt('SELECT * FROM r WHERE w IN (SELECT w FROM often)', 'kept')}"""
# Within a run of unlisted tokens the 1st, 3rd, ... remove; r removals of a word take
# its first r unlisted copies.
REMOVE_RARE_COMPAT = f"""
WITH r AS (SELECT *, w IN {STOP} AS stop FROM ({rows()})),
runs AS (SELECT *, count(*) FILTER (stop) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM r),
hits AS (SELECT *, NOT stop AND row_number() OVER (PARTITION BY doc_id, run, stop ORDER BY pos) % 2 = 1
         AS hit FROM runs),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, w ORDER BY pos) AS nth,
           count(*) FILTER (hit) OVER (PARTITION BY doc_id, w) AS gone FROM hits)
{rebuilt('SELECT * FROM ranked WHERE stop OR nth > gone', 'kept')}"""

MASK = "4294967295::UBIGINT"


def rotated(x: str, bits: int) -> str:
    return f"(((({x}) << {bits}) & {MASK}) | (({x}) >> {32 - bits}))"


def times(x: str, factor: int) -> str:
    return f"((({x}) * {factor}::UBIGINT) & {MASK})"


def mixed(k: str) -> str:
    return times(rotated(times(k, 0xCC9E2D51), 15), 0x1B873593)


def byte(i: str) -> str:
    return f"('0x' || substring(x, ({i}) * 2 + 1, 2))::UBIGINT"


BLOCK = " + ".join(f"{byte(f'i * 4 + {j}')} * {256 ** j}::UBIGINT" for j in range(4))
TAIL = " + ".join(
    f"CASE WHEN n % 4 > {j} THEN {byte(f'n - n % 4 + {j}')} * {256 ** j}::UBIGINT ELSE 0::UBIGINT END"
    for j in range(3)
)
ROUND = f"(({times(rotated(f'xor(h, {mixed(chr(107))})', 13), 5)} + {0xE6546B64}::UBIGINT) & {MASK})"
# MurmurHash3 (32 bit, seed 42) of each distinct term.
HASHED_TFIDF = f"""
WITH r AS ({rows()}),
t AS (SELECT w, hex(encode(w)) AS x, octet_length(encode(w)) AS n FROM (SELECT DISTINCT w FROM r)),
h1 AS (SELECT w, n, x, list_reduce(list_transform(range(0, n // 4), lambda i: {BLOCK}),
       lambda h, k: {ROUND}, 42::UBIGINT) AS h FROM t),
h2 AS (SELECT w, n, xor(h, {mixed(f'({TAIL})')}) AS h FROM h1),
h3 AS (SELECT w, xor(h, n::UBIGINT) AS h FROM h2),
h4 AS (SELECT w, {times('xor(h, h >> 16)', 0x85EBCA6B)} AS h FROM h3),
h5 AS (SELECT w, {times('xor(h, h >> 13)', 0xC2B2AE35)} AS h FROM h4),
h6 AS (SELECT w, xor(h, h >> 16)::BIGINT AS h FROM h5),
b AS (SELECT w, (((CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END) % 3) + 3) % 3 AS b FROM h6),
tf AS (SELECT doc_id, b, count(*) AS tf FROM r JOIN b USING (w) GROUP BY ALL),
idf AS (SELECT b, ln((any_value(m) + 1.0::DOUBLE) / (count(*) + 1.0::DOUBLE)) AS idf
        FROM tf, (SELECT count(*) AS m FROM documents) GROUP BY b)
SELECT d.doc_id,
  {', '.join(f'coalesce(max(tf) FILTER (b = {i}), 0) AS tf_{i}' for i in range(3))},
  {', '.join(f'round(coalesce(max(tf * idf) FILTER (b = {i}), 0.0), 6) AS tfidf_{i}' for i in range(3))}
FROM documents d LEFT JOIN (SELECT doc_id, b, tf, idf FROM tf JOIN idf USING (b)) USING (doc_id)
GROUP BY d.doc_id"""

VECTORS = HASHED_TFIDF[: HASHED_TFIDF.index("idf AS")].rstrip().rstrip(",") + """
SELECT d.doc_id, '(3,[' || coalesce(string_agg(b::VARCHAR, ',' ORDER BY b), '') || '],['
       || coalesce(string_agg(tf || '.0', ',' ORDER BY b), '') || '])' AS tf
FROM documents d LEFT JOIN tf USING (doc_id) GROUP BY d.doc_id"""

# ---- numbers ---------------------------------------------------------------

HUNDRED = "[" + ", ".join(quote(w) for w in BELOW_HUNDRED) + "]"
SCALE = "[" + ", ".join(quote(s) for s in GROUP_NAMES) + "]"


def below_thousand(v: str) -> str:
    return (
        f"(CASE WHEN {v} >= 100 THEN {HUNDRED}[{v} // 100 + 1] || ' hundred' ELSE '' END "
        f"|| CASE WHEN {v} >= 100 AND {v} % 100 > 0 THEN ' and ' ELSE '' END "
        f"|| CASE WHEN {v} % 100 > 0 THEN {HUNDRED}[{v} % 100 + 1] ELSE '' END)"
    )


def cardinal(n: str) -> str:
    """Words of a whole number of up to four groups of three digits."""
    groups = [f"({n} // {1000 ** i} % 1000)" for i in range(3, -1, -1)]
    parts = []
    for i, g in zip(range(3, -1, -1), groups):
        before = f"({n} >= {1000 ** (i + 1)})"
        link = f"CASE WHEN NOT {before} THEN '' ELSE ', ' END"
        if i == 0:
            link = f"CASE WHEN NOT {before} THEN '' WHEN {g} < 100 THEN ' and ' ELSE ', ' END"
        parts.append(f"CASE WHEN {g} = 0 THEN '' ELSE {link} || {below_thousand(g)} || {SCALE}[{i + 1}] END")
    return f"CASE WHEN {n} = 0 THEN 'zero' ELSE {' || '.join(parts)} END"


CENTS = "(round(o_totalprice * 100)::BIGINT)"
NUMBER_TO_WORDS = f"""
SELECT o_orderkey, {cardinal('o_orderkey')} AS key_words,
  {cardinal(f'({CENTS} // 100)')} || CASE
    WHEN {CENTS} % 100 = 0 THEN ''
    WHEN {CENTS} % 10 = 0 THEN ' point ' || {HUNDRED}[{CENTS} % 100 // 10 + 1]
    ELSE ' point ' || {HUNDRED}[{CENTS} % 100 // 10 + 1] || ' ' || {HUNDRED}[{CENTS} % 10 + 1]
  END AS price_words, NULL::VARCHAR AS not_a_number
FROM orders"""

# ---- sentiment --------------------------------------------------------------

NEGATIVE = f"(lower(%s) IN {in_list(NEGATIONS)} OR contains(lower(%s), 'n''t'))"
STRONG, WEAK = in_list(STRONGER), in_list(WEAKER)


def shouts(w: str) -> str:
    return f"({w} = upper({w}) AND {w} <> lower({w}))"


def boosted(i: int) -> str:
    """Valence ``v`` after the word ``i`` places before has had its effect."""
    w, fade = f"w{i}", {1: 1.0, 2: 0.95, 3: 0.9}[i]
    scalar_ = (
        f"(CASE WHEN lower({w}) IN {STRONG} THEN sgn(v) * 0.293 WHEN lower({w}) IN {WEAK} "
        f"THEN sgn(v) * -0.293 END + CASE WHEN {shouts(w)} AND mixed "
        f"THEN CASE WHEN v > 0 THEN 0.733 ELSE -0.733 END ELSE 0 END)"
    )
    never = {
        1: "false",
        2: "w2 = 'never' AND w1 IN ('so', 'this')",
        3: "(w3 = 'never' AND w2 IN ('so', 'this')) OR w1 IN ('so', 'this')",
    }[i]
    factor = {1: 1.0, 2: 1.5, 3: 1.25}[i]
    turn = f"CASE WHEN {never} THEN {factor} WHEN {NEGATIVE % (w, w)} THEN -0.74 ELSE 1 END"
    return (
        f"CASE WHEN i > {i} AND {w} IS NOT NULL AND v{i} IS NULL "
        f"THEN (v + coalesce({scalar_} * {fade}::DOUBLE, 0)) * ({turn})::DOUBLE ELSE v END"
    )


def idiom(*words: str) -> str:
    phrase = " || ' ' || ".join(words)
    return f"CASE {phrase} " + " ".join(f"WHEN {quote(p)} THEN {v}" for p, v in IDIOMS.items()) + " END"


PHRASES = f"""CASE WHEN i > 3 AND v3 IS NULL THEN coalesce({idiom("w0", "n1", "n2")}, {idiom("w0", "n1")},
  {idiom("w1", "w0")}, {idiom("w2", "w1", "w0")}, {idiom("w2", "w1")}, {idiom("w3", "w2", "w1")},
  {idiom("w3", "w2")}, v)::DOUBLE - CASE WHEN w3 || ' ' || w2 IN {in_list(WEAKER_PAIRS)}
  OR w2 || ' ' || w1 IN {in_list(WEAKER_PAIRS)} THEN 0.293::DOUBLE ELSE 0 END ELSE v END"""

SENTIMENT = f"""
WITH lex AS (SELECT w, ((length(w) % 7) - 3.0)::DOUBLE AS valence FROM ({BENCHMARK_TERMS}) WHERE length(w) > 1),
p AS (SELECT doc_id, text, list_transform(list_filter(regexp_split_to_array(text, '{SPACE}+'),
        lambda w: length(w) > 1), lambda w: CASE WHEN regexp_matches(w, {quote(MARKED_WORD)})
        THEN translate(w, {P}, '') ELSE w END) AS a FROM documents),
d AS (SELECT doc_id, a, len(a) AS n, len(list_filter(a, lambda w: {shouts('w')})) AS loud,
        list_position(list_transform(a, lambda w: lower(w)), 'but') AS but,
        least(length(text) - length(replace(text, '!', '')), 4) * 0.292::DOUBLE +
        CASE WHEN length(text) - length(replace(text, '?', '')) <= 1 THEN 0
             WHEN length(text) - length(replace(text, '?', '')) <= 3
             THEN (length(text) - length(replace(text, '?', ''))) * 0.18::DOUBLE ELSE 0.96 END AS emph FROM p),
w AS (SELECT doc_id, loud > 0 AND loud < n AS mixed, but, generate_subscripts(a, 1) AS i, unnest(a) AS w0 FROM d),
x AS (SELECT *, lag(w0, 1) OVER o AS w1, lag(w0, 2) OVER o AS w2, lag(w0, 3) OVER o AS w3,
        lead(w0, 1) OVER o AS n1, lead(w0, 2) OVER o AS n2 FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
y AS (SELECT x.*, l1.valence AS v1, l2.valence AS v2, l3.valence AS v3,
        l0.valence + CASE WHEN {shouts('w0')} AND mixed THEN CASE WHEN l0.valence > 0 THEN 0.733 ELSE -0.733 END
                     ELSE 0 END::DOUBLE AS v
      FROM x JOIN lex l0 ON lower(w0) = l0.w LEFT JOIN lex l1 ON lower(w1) = l1.w
      LEFT JOIN lex l2 ON lower(w2) = l2.w LEFT JOIN lex l3 ON lower(w3) = l3.w
      WHERE lower(w0) NOT IN {STRONG} AND lower(w0) NOT IN {WEAK}
        AND NOT (lower(w0) = 'kind' AND coalesce(lower(n1), '') = 'of')),
z1 AS (SELECT * REPLACE ({boosted(1)} AS v) FROM y),
z2 AS (SELECT * REPLACE ({boosted(2)} AS v) FROM z1),
z3 AS (SELECT * REPLACE ({boosted(3)} AS v) FROM z2),
z4 AS (SELECT * REPLACE (CASE WHEN lower(w1) = 'least' AND v1 IS NULL
         AND coalesce(lower(w2) NOT IN ('at', 'very'), true) THEN v * -0.74 ELSE v END AS v)
       FROM (SELECT * REPLACE ({PHRASES} AS v) FROM z3)),
z5 AS (SELECT doc_id, v * CASE WHEN but > 0 AND i < but THEN 0.5 WHEN but > 0 AND i > but THEN 1.5
         ELSE 1 END::DOUBLE AS v FROM z4),
s AS (SELECT doc_id, sum(v) AS t, sum(v + 1) FILTER (v > 0) AS up, sum(1 - v) FILTER (v < 0) AS down,
        count(*) FILTER (v <> 0) AS c FROM z5 GROUP BY doc_id),
e AS (SELECT d.doc_id, n - coalesce(c, 0) AS flat, coalesce(t, 0) + sign(coalesce(t, 0)) * emph AS t,
        coalesce(up, 0) + CASE WHEN coalesce(up, 0) > coalesce(down, 0) THEN emph ELSE 0 END AS up,
        coalesce(down, 0) + CASE WHEN coalesce(up, 0) < coalesce(down, 0) THEN emph ELSE 0 END AS down
      FROM d LEFT JOIN s ON d.doc_id = s.doc_id)
SELECT doc_id, coalesce(round(down / nullif(up + down + flat, 0), 3), 0.0) AS neg,
  coalesce(round(flat / nullif(up + down + flat, 0), 3), 0.0) AS neu,
  coalesce(round(up / nullif(up + down + flat, 0), 3), 0.0) AS pos,
  round(t / sqrt(t * t + 15), 4) AS compound FROM e""".replace("sgn(v)", "(CASE WHEN v < 0 THEN -1 ELSE 1 END)")


def of_turns(query: str, *outputs: str) -> str:
    """A query of documents for the turns of conversations, numbered."""
    return f"""WITH turns AS MATERIALIZED (SELECT row_number() OVER () AS doc_id, * FROM conversations)
SELECT conv_id, turn, {", ".join(outputs)}
FROM turns JOIN ({query.replace("FROM documents", "FROM turns")}) USING (doc_id)"""


# ---- all ---------------------------------------------------------------------

SIZES = "try_cast(regexp_extract(p_size::VARCHAR, '^[+-]?[0-9]+') AS INTEGER)"
CUSTOMER = "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"
NAMES = "SELECT c_custkey, lower(c_name) AS name FROM customer"

ORACLE: dict[str, str] = {
    "lower_text": scalar("lower(text)", "lowered"),
    "replace_pattern": scalar("regexp_replace(text, 'the', 'x', 'g')", "replaced"),
    "replace_literal": scalar(
        "replace(c_name, 'Customer#', 'No. ')", "replaced", "customer", "c_custkey"
    ),
    "strip_punctuation": scalar(f"translate(text, {P}, '')", "stripped"),
    "strip_non_ascii": scalar("regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')", "stripped"),
    "strip_numbers": scalar("regexp_replace(text, '\\p{Nd}+', '', 'g')", "stripped"),
    "tokenize": listed(tokens("text"), "tokens"),
    "remove_stop_words": listed(
        f"list_filter({tokens('text')}, lambda w: w NOT IN {STOP})", "kept"
    ),
    "stem_tokens": STEMS,
    "lemmatize_tokens": LEMMATIZE,
    "normalize": NORMALIZE,
    "extract_emails": listed(f"regexp_extract_all(text, '{SPACE.replace('[', '[^')}+@{SPACE.replace('[', '[^')}+')", "emails"),
    "extract_urls": listed("regexp_extract_all(url, 'https?://[a-zA-Z!$-_]+')", "urls", "pages", "page_id"),
    "strip_tags": scalar("regexp_replace(html, '<.*?>', '', 'g')", "stripped", "pages", "page_id"),
    "string_to_date": scalar(
        "strftime(strptime(strftime(o_orderdate, '%m/%d/%Y'), '%m/%d/%Y'), '%Y-%m-%d %H:%M:%S')",
        "parsed", "orders", "o_orderkey",
    ),
    "date_to_string": scalar("strftime(o_orderdate, '%d-%m-%Y')", "formatted", "orders", "o_orderkey"),
    "translate_terms": TRANSLATE,
    "translate_phrases": TRANSLATE_PHRASES,
    "token_ids": TOKEN_IDS,
    "translate_turns": of_turns(TRANSLATE, "translated"),
    "average_word_length": scalar(
        f"round(length(regexp_replace(text, '{SPACE}+', '', 'g'))::DOUBLE / nullif(len(list_filter("
        f"regexp_split_to_array(text, '{SPACE}+'), lambda w: w <> '')), 0), 9)",
        "average",
    ),
    "word_count": scalar("len(string_split(text, ' '))::BIGINT", "words"),
    "character_count": scalar("length(replace(text, ' ', ''))::BIGINT", "characters"),
    "special_character_count": scalar(
        f"(length(text) - length(translate(text, {P}, '')))::BIGINT", "specials"
    ),
    "remove_frequent": REMOVE_FREQUENT,
    "remove_frequent_compat": (
        f"WITH r AS ({rows()}) {rebuilt(f'SELECT * FROM r WHERE w NOT IN {STOP}', 'kept')}"
    ),
    "frequent_terms": TOP,
    "remove_rare": REMOVE_RARE,
    "remove_rare_compat": REMOVE_RARE_COMPAT,
    "number_to_words": NUMBER_TO_WORDS,
    "column_summary": f"""SELECT count(*) AS count, (SELECT count(*) FROM (SELECT DISTINCT * FROM part)) AS
        "unique", max({SIZES}) AS maximum FROM part""",
    "column_summary_text": """SELECT count(*) AS count,
        (SELECT count(*) FROM (SELECT DISTINCT text, lang, source, n_chars FROM documents)) AS "unique",
        max(try_cast(nullif(regexp_extract(text, '^\\s*([+-]?[0-9]+)(?:[.][0-9]*)?\\s*$', 1), '') AS INTEGER))
        AS maximum FROM documents""",
    "column_uniques": """SELECT count(DISTINCT user_id) AS user_id, count(DISTINCT event_type) AS event_type,
        count(DISTINCT props) AS props FROM events""",
    "spell_correct": SPELL,
    "split_joined": SPLIT,
    "correct_in_context": SPELL_CONTEXT,
    "top_terms": TOP.replace("LIMIT 20", "LIMIT 5000"),
    "group_values": "SELECT p_type, p_size, count(*) AS count FROM part GROUP BY ALL",
    "group_info": f"""SELECT (SELECT count(*) FROM (SELECT DISTINCT p_type FROM part)) AS count,
        max({SIZES}) AS maximum, min({SIZES}) AS minimum FROM part""",
    "group_summary": f"""SELECT p_type, count(*) AS count, max({SIZES}) AS maximum, min({SIZES}) AS minimum
        FROM part GROUP BY p_type""",
    "hashed_tfidf": HASHED_TFIDF,
    "doc_terms": DOC_TERMS,
    "sentiment": SENTIMENT,
    "sentiment_of_turns": of_turns(SENTIMENT, "neg", "neu", "pos", "compound"),
    "json_scan": CUSTOMER,
    "json_column": "SELECT (props::JSON ->> 'k')::BIGINT AS k, count(*) AS n FROM events GROUP BY 1",
    "sql_view": "SELECT n_name FROM nation",
    "append_once": NAMES,
    "normalize_sinks": f"UNPIVOT ({NORMALIZE}) ON COLUMNS(* EXCLUDE doc_id) INTO NAME stage VALUE value",
    "written_summary": f"SELECT count(*) AS count, max({SIZES}) AS maximum, true AS close FROM part",
    "daily_uniques": """
        SELECT strftime(ts, '%Y-%m') AS month, 'user_id' AS "column", count(user_id) AS count,
               count(DISTINCT user_id) AS exact, true AS close FROM events GROUP BY 1
        UNION ALL
        SELECT strftime(ts, '%Y-%m'), 'event_type', count(event_type), count(DISTINCT event_type), true FROM events GROUP BY 1
        UNION ALL
        SELECT strftime(ts, '%Y-%m'), 'value', count(value), count(DISTINCT value), true FROM events GROUP BY 1""",
    "changing_json": """
        SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN 'BIGINT' WHEN 1 THEN 'STRING' ELSE 'OBJECT<a: BIGINT>' END AS kind,
               CASE event_id % 3 WHEN 0 THEN user_id END AS number,
               CASE event_id % 3 WHEN 0 THEN user_id::VARCHAR WHEN 1 THEN event_type
                    ELSE '{"a":' || user_id || '}' END AS text,
               CASE event_id % 3 WHEN 2 THEN user_id END AS inner FROM events""",
    "vectors_as_text": VECTORS,
    "append_sink": f"{NAMES} UNION ALL {NAMES}",
    "overwrite_sink": f"SELECT p_partkey, {cardinal('p_size')} AS words FROM part",
    "json_lines": """SELECT to_json({'c_custkey': c_custkey, 'c_name': c_name,
        'c_mktsegment': c_mktsegment})::VARCHAR AS value FROM customer""",
    "flatten_arrays": f"""SELECT conv_id, turn, array_to_string({tokens('text')}, ',') AS tokens
        FROM conversations""",
    "bracketed_lists": """SELECT page_id, '[' || array_to_string(
        regexp_extract_all(url, 'https?://[a-zA-Z!$-_]+'), ', ') || ']' AS urls FROM pages""",
}
