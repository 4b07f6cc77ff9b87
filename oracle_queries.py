"""DuckDB statements that state each registered query's result independently."""

from __future__ import annotations

import math

from quillspark.plans import workload as W
from quillspark.sources import constants as K


# Patterns, written out here from the intended behaviour and not taken from the engine.
BLANKS = r"\t\n\x0B\f\r\x1C-\x20\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
BLANK = f"[{BLANKS}]"
LETTERS_DIGITS = r"\p{L}\p{N}_"
PUNCT_MARKS = r"""[ "\\,*_`:./;'\[\](){}<>~^?&!=+#-]"""
TO_BLANK = r"""[\p{Nd}!"#$%&'()*+,./:;?@\[\]^_{}-]"""


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lits(items) -> str:
    return ", ".join(lit(i) for i in items)


def sub(x: str, pattern: str, replacement: str) -> str:
    return f"regexp_replace({x}, {lit(pattern)}, {lit(replacement)}, 'g')"


STOP = lits(W.STOPWORDS)
PUNCT = lits(K.PUNCT_WORDS)
LETTERS = "[" + lits("abcdefghijklmnopqrstuvwxyz") + "]"


def norm(x: str) -> str:
    x = sub(f"lower({x})", BLANK + "+", " ")
    x = sub(x, "([,.;!?:)])", r" \1")
    x = sub(x, "([(])", r"\1 ")
    x = sub(x, '([/"&*=])', r" \1 ")
    return sub(x, " {2,}", " ")


def plain(x: str) -> str:
    for anchor, name in K.CLIENT_ANCHORS:
        x = f"replace({x}, {lit(anchor)}, {lit(name)})"
    x = sub(f"lower({x})", TO_BLANK, " ")
    x = f"replace(replace({x}, '=', ' = '), 'https', '')"
    return f"trim({sub(x, BLANK + '+', ' ')})"


def normalize(x: str) -> str:
    return f"lower({sub(x, BLANK + '{2,}', ' ')})"


def corpus(x: str) -> str:
    return normalize(f"translate({x}, chr(10), ' ')")


def words(x: str) -> str:
    return f"regexp_extract_all({x}, {lit(f'[{LETTERS_DIGITS}]+')})"


def long_words(x: str) -> str:
    return f"regexp_extract_all(lower({x}), {lit(f'[{LETTERS_DIGITS}]{{2,}}')})"


def marks(x: str) -> str:
    return f"regexp_extract_all({x}, {lit(f'[{LETTERS_DIGITS}]+|[^{LETTERS_DIGITS}{BLANKS}]')})"


def cleaned(x: str) -> str:
    return sub(x, PUNCT_MARKS, "")


def split_white(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, {lit(BLANK + '+')}), lambda t: t <> '')"


def clean_tokens(x: str) -> str:
    kept = f"list_filter({split_white(x)}, lambda t: t NOT IN ({PUNCT}))"
    return f"list_filter(list_transform({kept}, lambda t: {cleaned('t')}), lambda t: t <> '')"


def split_each(x: str) -> str:
    return f"regexp_split_to_array({x}, {lit('[ \\t\\n\\x0B\\f\\r]')})"


def each(source: str, key: str, items: str, name: str) -> str:
    """Rows (key, pos, name) of a list expression, pos 0-based."""
    return (
        f"SELECT {key}, unnest(range(len(l))) AS pos, unnest(l) AS {name} "
        f"FROM (SELECT {key}, {items} AS l FROM {source})"
    )


def sentence_rows(source: str, key: str, x: str) -> str:
    """Rows (key, pos, sentence): tokens grouped up to each token that closes a sentence."""
    whole = f"{x} || CASE WHEN {x} LIKE '%.' THEN '' WHEN {x} LIKE '%!' OR {x} LIKE '%?' THEN ' .' ELSE '.' END"
    quoted = "lambda t: regexp_replace(t, '([.?!])([\"”])$', '\\2\\1')"
    core = "regexp_replace(lower(ts[i]), '[)\\]'']+$', '')"
    never = lits([f"{t}." for t in K.TITLES] + ["e.g.", "i.e."])
    suffix = lits(f"{t}." for t in K.SUFFIXES)
    closes = f"""CASE WHEN i = len(ts) OR right({core}, 1) IN ('!', '?') THEN true
      WHEN right({core}, 1) <> '.' OR right({core}, 2) = '..' THEN false
      WHEN {core} IN ({never}) OR regexp_full_match({core}, '[a-z]\\.') THEN false
      WHEN {core} IN ({suffix}) OR regexp_full_match({core}, '([a-z]{{1,2}}\\.){{2,}}')
        THEN lower(ts[i + 1]) IN ({lits(K.STARTERS)})
      ELSE true END"""
    return f"""SELECT {key}, unnest(range(len(e))) AS pos, unnest(list_transform(range(1, len(e) + 1),
      lambda k: array_to_string(ts[(CASE WHEN k = 1 THEN 0 ELSE e[k - 1] END) + 1 : e[k]], ' '))) AS sentence
    FROM (SELECT {key}, ts, list_filter(range(1, len(ts) + 1), lambda i: {closes}) AS e
          FROM (SELECT {key}, list_transform({split_white(whole)}, {quoted}) AS ts FROM {source}))"""


POSTS = """posts AS (
  SELECT c.conv_id * 1000 + c.turn AS post_id, c.role AS author,
    CASE WHEN c.turn % 3 = 0 THEN '@' || c.role || ' ' ELSE '' END ||
    CASE WHEN c.turn % 2 = 1 THEN '#Turn' || c.turn || ' ' ELSE '' END ||
    c.text || ' ' || coalesce(p.url, '') AS text, e.ts, e.event_type AS device
  FROM conversations c
  LEFT JOIN pages p ON p.page_id = c.conv_id % (SELECT count(*) FROM pages)
  LEFT JOIN events e ON e.event_id = c.conv_id)"""
TURNS = "turns AS (SELECT conv_id * 1000 + turn AS post_id, role, text FROM conversations)"


def draw32(*parts: str) -> str:
    return f"('0x' || substr(md5({' || chr(124) || '.join(parts)}), 1, 8))::BIGINT"


SEED = lit(str(W.SEED))
O: dict[str, str] = {}

# --- labels, projections, filters

O["label_encode"] = f"""WITH {POSTS}, f AS (SELECT author, min(post_id) AS m FROM posts GROUP BY 1),
c AS (SELECT author, row_number() OVER (ORDER BY m, author) - 1 AS code FROM f)
SELECT post_id, author, code FROM posts JOIN c USING (author)"""
O["one_hot"] = f"""WITH {POSTS}, f AS (SELECT device, min(post_id) AS m FROM posts GROUP BY 1),
c AS (SELECT device, row_number() OVER (ORDER BY m, device) - 1 AS code FROM f)
SELECT post_id, device, CASE WHEN code = 2 THEN 1 ELSE code END AS code,
  (author = 'assistant')::INT AS author_assistant, (author = 'user')::INT AS author_user
FROM posts JOIN c USING (device)"""
O["binary_target"] = f"""WITH {POSTS}
SELECT post_id, device, CASE WHEN device = 'click' THEN 0 ELSE 1 END AS target FROM posts"""
O["project_posts"] = f"""WITH {POSTS} SELECT post_id, device, 'train' AS part FROM posts
UNION ALL SELECT post_id, NULL, 'test' FROM posts"""
O["drop_nulls"] = "SELECT doc_id, lang, quality FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL"
O["nonempty_filter"] = f"""SELECT doc_id, length(p)::BIGINT AS plain_len FROM
(SELECT doc_id, {plain('text')} AS p FROM documents) WHERE length(p) > 0"""
O["class_limit"] = f"""WITH {POSTS} SELECT post_id, device, 1 AS target FROM posts
WHERE device IS DISTINCT FROM 'click' ORDER BY post_id LIMIT 50"""
O["parse_posts"] = f"WITH {POSTS} SELECT post_id, {plain('text')} AS text, author FROM posts"

# --- text

O["filter_text"] = f"SELECT doc_id, {plain('text')} AS plain FROM documents"
O["norm_text"] = f"SELECT doc_id, {norm('text')} AS norm FROM documents"
O["normalize_text"] = f"SELECT doc_id, {normalize('text')} AS norm FROM documents"
O["clean_terms"] = f"""SELECT doc_id, {cleaned('text')} AS cleaned,
array_to_string({clean_tokens('text')}, '|') AS tokens FROM documents"""
O["sentence_split"] = f"""WITH s AS ({sentence_rows('documents', 'doc_id', 'text')})
SELECT doc_id, pos AS sent, sentence FROM s"""
O["tokens"] = f"""SELECT doc_id, len(string_split(text, ' ')) AS space_tokens,
array_to_string({split_white('text')}, '|') AS white, array_to_string({words('text')}, '|') AS words,
len({split_each('text')}) AS each_white_tokens,
array_to_string({marks('text')}, '|') AS words_and_marks FROM documents"""

# tok: space tokens of the corpus form of the documents
TOK = f"""tok AS ({each('documents', 'doc_id', f"list_filter(string_split({corpus('text')}, ' '), lambda t: t <> '')", 't')})"""
TRI = f"""{TOK}, tri AS (SELECT t AS w1, lead(t) OVER w AS w2, lead(t, 2) OVER w AS w3 FROM tok
  WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
g AS (SELECT w1 || ' ' || w2 || ' ' || w3 AS gram, w1 || ' ' || w2 AS ctx, w3 AS last, w1, w2, count(*) AS n
  FROM tri WHERE w3 IS NOT NULL GROUP BY w1, w2, w3)"""
O["ngram_stopfilter"] = f"""WITH {TOK}, b AS (SELECT t AS w1, lead(t) OVER (PARTITION BY doc_id ORDER BY pos) AS w2 FROM tok)
SELECT w1 || ' ' || w2 AS gram, count(*) AS n FROM b
WHERE w2 IS NOT NULL AND (w1 NOT IN ({STOP}) OR w2 NOT IN ({STOP})) GROUP BY 1"""
O["words_from_ngrams"] = f"""WITH {TRI}, m AS (SELECT max(gram) AS gram FROM g),
u AS (SELECT w1 AS word, n FROM g UNION ALL SELECT unnest(string_split(gram, ' ')[2:]), 1 FROM m)
SELECT word, sum(n)::BIGINT AS n FROM u GROUP BY 1"""

# --- features


def count_class(x: str, char_class: str) -> str:
    return f"(length({x}) - length({sub(x, char_class, '')}))"


O["corpus_counters"] = f"""WITH {POSTS}, t AS (SELECT unnest(string_split(text, ' ')) AS t FROM posts)
SELECT count(*) FILTER (t LIKE '#%') AS i_hash, count(*) FILTER (t LIKE '@%') AS i_via,
count(*) FILTER (t LIKE 'http%') AS i_url,
coalesce(sum({count_class('t', '[A-Z]')}) FILTER (t NOT LIKE '#%' AND t NOT LIKE '@%' AND t NOT LIKE 'http%'), 0)::BIGINT AS i_capital
FROM t"""


def named(x: str, parts) -> str:
    return "(" + " OR ".join(f"contains({x}, {lit(p)})" for p in parts) + ")"


def feature_ctes() -> str:
    """feat: one row per post with every content and time feature, unrounded."""
    mention_sums = ", ".join(
        f"sum(CASE WHEN kind = 'plain' THEN len(list_filter(pieces, lambda w: {named('w', parts)})) "
        f"WHEN kind = 'tag' AND body = {lit(handle)} THEN 1 ELSE 0 END)::BIGINT AS {name}"
        for name, (parts, handle) in W.MENTIONS.items()
    )
    names = ", ".join(W.MENTIONS)
    return f"""{POSTS}, ft AS ({each('posts', 'post_id', "string_split(text, ' ')", 'tk')}),
fb AS (SELECT post_id, pos, CASE WHEN tk[1] IN ('"', '.') THEN [tk[1]] ELSE [] END AS lead_,
  CASE WHEN tk[1] IN ('"', '.') THEN substr(tk, 2) ELSE tk END AS body FROM ft),
fk AS (SELECT *, CASE WHEN body LIKE '@%' THEN 'tag' WHEN body LIKE '#%' THEN 'hash'
  WHEN body LIKE 'http%' THEN 'url' ELSE 'plain' END AS kind FROM fb),
fp AS (SELECT *, CASE WHEN kind = 'url' THEN [] ELSE string_split({norm('body')}, ' ') END AS pieces FROM fk),
fa AS (SELECT post_id, array_to_string(flatten(list(list_concat(lead_, pieces) ORDER BY pos)), ' ') AS features_group,
  sum(len(lead_) + len(pieces))::BIGINT AS contents,
  count(*) FILTER (kind = 'hash') AS i_hash, count(*) FILTER (kind = 'url') AS i_url, count(*) FILTER (kind = 'tag') AS i_tag,
  coalesce(sum({count_class('body', '[A-Z]')}) FILTER (kind = 'plain'), 0)::BIGINT AS i_capital,
  coalesce(sum(len(list_filter(pieces, lambda w: w IN ({STOP})))) FILTER (kind = 'plain'), 0)::BIGINT AS i_stopword,
  {mention_sums} FROM fp GROUP BY post_id),
fc AS (SELECT *, {count_class('features_group', '[!-?]')}::BIGINT AS i_punc FROM fa),
feat AS (SELECT post_id, features_group, device, i_hash, i_url, i_tag, i_capital, i_punc,
  contents - i_punc AS i_terms, i_punc / (CASE WHEN contents = i_punc THEN 1 ELSE contents - i_punc END) AS puncs,
  i_stopword, {names}, hour(ts)::BIGINT AS i_hours, (isodow(ts) - 1)::BIGINT AS i_days
  FROM fc JOIN posts USING (post_id))"""


FEAT = feature_ctes()
COUNT_COLS = [c for c in K.COUNT_FEATURES]
O["content_features"] = f"""WITH {FEAT} SELECT post_id, features_group, {', '.join(W.COUNTS)},
round(puncs, 6) AS puncs, i_hours, i_days FROM feat"""
O["time_features"] = """SELECT event_id, hour(ts)::BIGINT AS hour, (isodow(ts) - 1)::BIGINT AS weekday,
year(ts)::BIGINT AS year, month(ts)::BIGINT AS month FROM events"""


def term_list(x: str, bigrams: bool = False) -> str:
    kept = f"list_filter({long_words(x)}, lambda w: w NOT IN ({STOP}))"
    return kept


def tf_ctes(source: str, key: str, x: str, prefix: str, bigrams: bool = False) -> str:
    """{prefix}tf: (key, term, tf)."""
    base = f"{prefix}w AS ({each(source, key, term_list(x), 'w')})"
    terms = f"SELECT {key}, w AS term FROM {prefix}w"
    if bigrams:
        terms += f""" UNION ALL SELECT {key}, term FROM (SELECT {key},
          w || ' ' || lead(w) OVER (PARTITION BY {key} ORDER BY pos) AS term FROM {prefix}w) WHERE term IS NOT NULL"""
    return f"{base}, {prefix}tf AS (SELECT {key}, term, count(*) AS tf FROM ({terms}) GROUP BY 1, 2)"


def idf_cte(source: str, prefix: str, min_df: int, cap: int | None = None) -> str:
    limit = f"ORDER BY total DESC, term LIMIT {cap}" if cap else ""
    return f"""{prefix}idf AS (SELECT term, ln((1 + (SELECT count(*) FROM {source})) / (1 + df)) + 1 AS idf FROM
    (SELECT term, count(*) AS df, sum(tf) AS total FROM {prefix}tf GROUP BY 1 HAVING count(*) >= {min_df} {limit}))"""


def weights(tf: str, idf: str, key: str) -> str:
    return f"""SELECT {key}, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY {key})) AS weight FROM
    (SELECT {key}, term, tf * idf AS raw FROM {tf} JOIN {idf} USING (term))"""


O["tfidf_uni"] = f"""WITH {tf_ctes('documents', 'doc_id', 'text', 'd')}, {idf_cte('documents', 'd', 2)}
SELECT doc_id, term, round(weight, 6) AS weight FROM ({weights('dtf', 'didf', 'doc_id')})"""
O["tfidf_bigram_capped"] = f"""WITH {tf_ctes('documents', 'doc_id', 'text', 'd', True)}, {idf_cte('documents', 'd', 2, 5000)}
SELECT doc_id, term, round(weight, 6) AS weight FROM ({weights('dtf', 'didf', 'doc_id')})"""
O["tfidf_transform"] = f"""WITH {TURNS}, {tf_ctes('documents', 'doc_id', 'text', 'd')}, {idf_cte('documents', 'd', 2)},
{tf_ctes('turns', 'post_id', 'text', 't')}
SELECT post_id, term, round(weight, 6) AS weight FROM ({weights('ttf', 'didf', 'post_id')})"""


def scaled(c: str) -> str:
    low, high = f"min({c}) OVER ()", f"max({c}) OVER ()"
    return f"(({c} - {low}) / (CASE WHEN {high} = {low} THEN 1.0 ELSE ({high} - {low})::DOUBLE END))::DOUBLE"


O["minmax_scale"] = f"""WITH {FEAT} SELECT post_id, {', '.join(f'round({scaled(c)}, 6) AS {c}' for c in COUNT_COLS)} FROM feat"""
O["feature_table"] = f"""WITH {FEAT}, tgt AS (SELECT post_id, CASE WHEN device = 'click' THEN 0 ELSE 1 END AS target FROM posts),
sc AS (SELECT post_id, {', '.join(f'{scaled(c)} AS {c}' for c in COUNT_COLS)} FROM feat),
{tf_ctes('feat', 'post_id', 'features_group', 'f')}, {idf_cte('feat', 'f', 2)},
lng AS ({' UNION ALL '.join(f"SELECT post_id, '#{c}' AS feature, {c} AS value FROM sc" for c in COUNT_COLS)}
UNION ALL SELECT post_id, term, weight FROM ({weights('ftf', 'fidf', 'post_id')}))
SELECT post_id, target, feature, round(value, 6) AS value FROM lng JOIN tgt USING (post_id)"""
VOC = f"""vt AS ({each('documents', 'doc_id', marks('text'), 'term')}),
vi AS (SELECT term, row_number() OVER (ORDER BY m) + 1 AS idx FROM
 (SELECT term, min((doc_id, pos)) AS m FROM vt GROUP BY 1))"""
O["vocab_index"] = f"WITH {VOC} SELECT term, idx FROM vi"
O["encode_sequences"] = f"""WITH {VOC}, {TURNS}, q AS ({each('turns', 'post_id', f"({marks('text')})[:{W.WIDTH}]", 'term')}),
e AS (SELECT post_id, list(coalesce(idx, 1) ORDER BY pos) AS ids FROM q LEFT JOIN vi USING (term) GROUP BY 1)
SELECT post_id, array_to_string(list_resize(ids, {W.WIDTH}, 0), ' ') AS ids, len(ids)::BIGINT AS length FROM e"""
O["augment_synonyms"] = f"""WITH {TURNS}, v AS (SELECT DISTINCT unnest({words('lower(text)')}) AS word FROM documents),
k AS (SELECT word, array_to_string(list_sort(regexp_extract_all(word, '.')), '') AS letters FROM v WHERE length(word) > 3),
r AS (SELECT letters, min(word) AS synonym FROM k GROUP BY 1),
s AS (SELECT word AS term, synonym FROM k JOIN r USING (letters) WHERE word <> synonym),
q AS ({each('turns', 'post_id', "string_split(lower(text), ' ')", 'term')}),
c AS (SELECT post_id, pos, term, synonym, synonym IS NOT NULL AND
  {draw32("'" + str(W.SEED) + ":keep'", 'post_id::VARCHAR', 'pos::VARCHAR')} < {1 << 31} AS hit FROM q LEFT JOIN s USING (term))
SELECT post_id, string_agg(CASE WHEN hit THEN synonym ELSE term END, ' ' ORDER BY pos) AS augmented,
sum(hit::INT)::BIGINT AS replaced FROM c GROUP BY 1"""

# --- counts and reports

O["term_counts"] = "SELECT term, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS term FROM documents) GROUP BY 1"
O["sequence_stats"] = """SELECT count(*) AS sequences, max(length(text))::BIGINT AS max_len,
min(length(text))::BIGINT AS min_len, floor(avg(length(text)))::BIGINT AS mean_len FROM documents"""
O["class_balance"] = """SELECT quality, count(*) AS n, round(count(*) / (SELECT count(*) FROM labels), 6) AS ratio
FROM labels GROUP BY 1"""
O["corpus_report"] = f"""WITH {POSTS}, p AS (SELECT {plain('text')} AS text, author FROM posts)
SELECT 'terms' AS measure, count(DISTINCT t) AS value FROM (SELECT unnest(string_split(text, ' ')) AS t FROM p)
UNION ALL SELECT 'sequences', count(*) FROM p UNION ALL SELECT 'max_len', max(length(text)) FROM p
UNION ALL SELECT 'min_len', min(length(text)) FROM p UNION ALL SELECT 'mean_len', floor(avg(length(text)))::BIGINT FROM p
UNION ALL SELECT 'class:' || author, count(*) FROM p GROUP BY author"""
O["word_ngrams"] = f"WITH {TRI} SELECT gram, n FROM g"
O["char_ngrams"] = f"""WITH c AS ({each('documents', 'doc_id', f"regexp_extract_all({corpus('text')}, '(?s).')", 'c')}),
t AS (SELECT c || lead(c) OVER w || lead(c, 2) OVER w AS gram FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
SELECT gram, count(*) AS n FROM t WHERE gram IS NOT NULL GROUP BY 1"""
CLEAN = f"ct AS (SELECT term, count(*) AS tf FROM (SELECT unnest({clean_tokens(corpus('text'))}) AS term FROM documents) GROUP BY 1)"
O["clean_term_freq"] = f"WITH {CLEAN} SELECT term, tf FROM ct"
DOCWORDS = f"dw AS (SELECT word, count(*) AS n FROM (SELECT unnest({words(corpus('text'))}) AS word FROM documents) GROUP BY 1)"


def letter_cte(source: str, name: str, word: str = "word") -> str:
    return f"""{name}x AS (SELECT {word} AS w, n, unnest(range(1, length({word}) + 1)) AS i FROM {source}),
{name} AS (SELECT chars, sum(n)::BIGINT AS n FROM (SELECT substr(w, i, 1) AS chars, n FROM {name}x
 UNION ALL SELECT substr(w, i, 2), n FROM {name}x WHERE i < length(w)) GROUP BY 1)"""


O["letter_counts"] = f"""WITH {DOCWORDS}, hw AS (SELECT '#' || word AS word, n FROM dw), {letter_cte('hw', 'lc')}
SELECT chars, n FROM lc"""
PTOK = f"""pt AS ({each('documents', 'doc_id', f"list_filter({marks('lower(text)')}, lambda t: t <> '.')", 't')})"""
O["padded_ngrams"] = f"""WITH {PTOK}, pu AS (SELECT doc_id, pos, t FROM pt
 UNION ALL SELECT doc_id, -1, NULL FROM documents UNION ALL SELECT doc_id, 1000000000, NULL FROM documents),
b AS (SELECT t AS w1, lead(t) OVER w AS w2, row_number() OVER w AS r, count(*) OVER (PARTITION BY doc_id) AS c
 FROM pu WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
SELECT w1, w2, count(*) AS n FROM b WHERE r < c AND
 (w1 IS NULL OR w2 IS NULL OR w1 NOT IN ({STOP}) OR w2 NOT IN ({STOP})) GROUP BY 1, 2"""
CONT = f"""{PTOK}, ptri AS (SELECT t AS w1, lead(t) OVER w AS w2, lead(t, 2) OVER w AS w3 FROM pt
 WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
pc AS (SELECT w1, w2, w3, count(*) AS n FROM ptri WHERE w3 IS NOT NULL GROUP BY 1, 2, 3)"""
O["trigram_continuations"] = f"""WITH {CONT} SELECT w1, w2, w3, n FROM pc
WHERE w1 NOT IN ({STOP}) OR w2 NOT IN ({STOP}) OR w3 NOT IN ({STOP})"""
O["singleton_terms"] = f"""WITH {CLEAN} SELECT count(*) FILTER (tf = 1) AS singletons,
count(*) FILTER (tf > 1) AS repeated FROM ct"""


def fold_expr(key: str, k: int, by: str = "") -> str:
    part = f"PARTITION BY {by} " if by else ""
    return f"(row_number() OVER ({part}ORDER BY md5({SEED} || '|' || {key}), {key}) - 1) % {k}"


PREDS = f"""ld AS (SELECT doc_id, quality AS y, length(text) AS len, len({words('text')}) AS words,
 {fold_expr('doc_id', 10)} AS fold FROM documents JOIN labels USING (doc_id)),
preds AS (SELECT 'length' AS model, fold, y, (len > (SELECT avg(len) FROM ld))::INT AS pred FROM ld
 UNION ALL SELECT 'parity', fold, y, (words % 2)::INT FROM ld)"""
METRICS = f"""{PREDS}, cf AS (SELECT model, fold::VARCHAR AS fold, count(*) FILTER (y = 1 AND pred = 1) AS tp,
 count(*) FILTER (y <> 1 AND pred = 1) AS fp, count(*) FILTER (y <> 1 AND pred <> 1) AS tn,
 count(*) FILTER (y = 1 AND pred <> 1) AS fn FROM preds GROUP BY 1, 2),
pr AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p,
 CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r, (tp + fn) / (tp + fp + tn + fn) AS pi FROM cf),
ms AS (SELECT model, fold, (tp + tn) / (tp + fp + tn + fn) * 100 AS acc, p * 100 AS pre, r * 100 AS rec,
 CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END * 100 AS f1,
 CASE WHEN tp + fn > 0 AND tn + fp > 0 THEN (tp / (tp + fn) + tn / (tn + fp)) / 2 END AS auc,
 CASE WHEN tp + fp = 0 OR tn + fn = 0 THEN (pi + 1) / 2 ELSE (1 - r) * (pi + p) / 2 + r * (p + 1) / 2 END AS prauc FROM pr),
res AS (SELECT model AS "Model", coalesce(fold, 'AVG') AS "Fold", round(avg(acc), 3) AS "Accuracy",
 round(avg(pre), 3) AS "Precision", round(avg(rec), 3) AS "Recall", round(avg(f1), 3) AS "F1",
 round(avg(auc), 3) AS "AUC", round(avg(prauc), 3) AS "PRAUC" FROM ms GROUP BY GROUPING SETS ((model, fold), (model)))"""
O["metrics_by_fold"] = f"WITH {METRICS} SELECT * FROM res"
O["best_model"] = f"""WITH {METRICS} SELECT "Model", "F1" FROM res WHERE "Fold" = 'AVG' ORDER BY "F1" DESC, "Model" LIMIT 1"""
O["pred_totals"] = f"""WITH {PREDS} SELECT CASE WHEN pred = 0 THEN 'first' ELSE 'second' END AS author, count(*) AS n
FROM preds GROUP BY 1"""

# --- language model

O["lm_model"] = f"WITH {TRI} SELECT gram, ctx, last, n FROM g"
QTOK = f"""{TURNS}, qt AS ({each('turns', 'post_id', split_each(corpus('text')), 't')}),
qw AS (SELECT post_id, pos, t AS t1, lead(t) OVER w AS t2, lead(t, 2) OVER w AS t3 FROM qt
 WINDOW w AS (PARTITION BY post_id ORDER BY pos))"""
PAIRS = """lp AS (SELECT ctx, last, n FROM g UNION ALL SELECT w1, last, sum(n) FROM g GROUP BY 1, 2
 UNION ALL SELECT '', last, sum(n) FROM g GROUP BY 2), lt AS (SELECT ctx, sum(n) AS total FROM lp GROUP BY 1)"""
O["lm_prefix_tf"] = f"""WITH {TRI}, {PAIRS}, {QTOK}, s AS (SELECT DISTINCT t1, t2 FROM qw WHERE t2 IS NOT NULL),
pf AS (SELECT ctx AS sub, total FROM lt UNION ALL SELECT gram, n FROM g)
SELECT t1 || ' ' || t2 AS sub, round(coalesce(pf.total,
 (coalesce(lp.n, 0) + 1) / (coalesce(lt.total, 0) + (SELECT count(*) FROM g)))::DOUBLE, 9) AS tf
FROM s LEFT JOIN pf ON pf.sub = t1 || ' ' || t2 LEFT JOIN lt ON lt.ctx = t1 LEFT JOIN lp ON lp.ctx = t1 AND lp.last = t2"""
O["lm_loglik"] = f"""WITH {TRI}, {PAIRS}, {QTOK},
qc AS (SELECT post_id, array_to_string(list_filter([t1, t2], lambda t: t NOT IN ({PUNCT})), ' ') AS ctx, t3 AS next
 FROM qw WHERE t3 IS NOT NULL),
sc AS (SELECT post_id, ln(CASE WHEN lp.n > 0 THEN lp.n / lt.total ELSE 1 / (coalesce(lt.total, 0) + (SELECT count(*) FROM g)) END) AS lnp
 FROM qc LEFT JOIN lp ON lp.ctx = qc.ctx AND lp.last = qc.next LEFT JOIN lt ON lt.ctx = qc.ctx)
SELECT post_id, round(coalesce(sum(lnp), 0), 5) AS loglik, count(lnp) AS windows FROM turns LEFT JOIN sc USING (post_id) GROUP BY 1"""
O["lm_smooth"] = f"""WITH {TRI}, {QTOK}, s AS (SELECT DISTINCT t1 || ' ' || t2 AS ctx, t3 AS next FROM qw WHERE t3 IS NOT NULL),
gt AS (SELECT ctx, sum(n) AS total FROM g GROUP BY 1)
SELECT s.ctx, s.next, round((coalesce(g.n, 0) + 1) / (coalesce(total, 0) + (SELECT count(*) FROM g)), 9) AS p
FROM s LEFT JOIN g ON g.ctx = s.ctx AND g.last = s.next LEFT JOIN gt ON gt.ctx = s.ctx"""
DRAW = draw32(SEED, "post_id::VARCHAR", "'1'")
O["lm_generate_step"] = f"""WITH {TRI}, {QTOK}, s AS (SELECT post_id, array_to_string(l[-2:], ' ') AS ctx FROM
 (SELECT post_id, {split_each(corpus('text'))} AS l FROM turns)),
gt AS (SELECT ctx, sum(n) AS total FROM g GROUP BY 1),
cum AS (SELECT ctx, gram, last, n, sum(n) OVER (PARTITION BY ctx ORDER BY md5(gram), gram) AS hi,
 row_number() OVER (ORDER BY md5(gram), gram) AS pick FROM g),
d AS (SELECT post_id, ctx, total, {DRAW} % coalesce(total, (SELECT count(*) FROM g))::BIGINT AS r FROM s LEFT JOIN gt USING (ctx))
SELECT post_id, d.ctx, coalesce(a.gram, b.gram) AS gram, coalesce(a.last, b.last) AS last FROM d
LEFT JOIN cum a ON a.ctx = d.ctx AND d.r >= a.hi - a.n AND d.r < a.hi
LEFT JOIN cum b ON d.total IS NULL AND b.pick = d.r + 1"""
O["lm_next_topk"] = f"""WITH {CONT} SELECT w1, w2, w3, n, rank FROM (SELECT *,
 row_number() OVER (PARTITION BY w1, w2 ORDER BY n DESC, w3) AS rank FROM pc) WHERE rank <= 3"""
def first_arrival(step: str) -> str:
    """The next word of every pair that wins the exponential race of a step."""
    key = f"{SEED} || '|' || ({step} // 4)::VARCHAR || '|' || w1 || '|' || w2 || '|' || w3"
    bits = f"('0x' || substr(md5({key}), (8 * ({step} % 4) + 1)::INT, 8))::BIGINT"
    return f"list(w3 ORDER BY -ln(({bits} + 0.5::DOUBLE) / 4294967296::DOUBLE) / n, w3)[1]"


O["lm_next_draw"] = f"WITH {CONT} SELECT w1, w2, {first_arrival('0')} AS w3 FROM pc GROUP BY 1, 2"
O["lm_continue"] = f"""WITH RECURSIVE {CONT}, st AS (SELECT unnest(range(19)) AS s),
d AS MATERIALIZED (SELECT w1, w2, s, {first_arrival('s')} AS next FROM pc, st GROUP BY 1, 2, 3),
a AS (SELECT DISTINCT l[1] AS w1, l[2] AS w2 FROM (SELECT list_filter({marks('lower(text)')}, lambda t: t <> '.') AS l
 FROM conversations) WHERE len(l) >= 2),
walk AS (SELECT w1, w2, w1 AS p1, w2 AS p2, []::VARCHAR[] AS said, 0 AS s FROM a
 UNION ALL SELECT k.w1, k.w2, k.p2, d.next, list_append(k.said, d.next), k.s + 1
 FROM walk k JOIN d ON d.w1 = k.p1 AND d.w2 = k.p2 AND d.s = k.s)
SELECT w1, w2, array_to_string(arg_max(said, s), ' ') AS continuation, max(s)::BIGINT AS n_words FROM walk GROUP BY 1, 2"""
O["lm_mle"] = f"""WITH {TURNS}, u AS (SELECT post_id, list_concat(['<s>', '<s>'], list_concat({marks('lower(text)')}, ['</s>', '</s>'])) AS l FROM turns),
t AS (SELECT post_id, unnest(range(len(l))) AS pos, unnest(l) AS t FROM u),
w AS (SELECT t AS w1, lead(t) OVER w AS w2, lead(t, 2) OVER w AS w3 FROM t WINDOW w AS (PARTITION BY post_id ORDER BY pos)),
e AS (SELECT 1 AS k, '' AS ctx, w1 AS word FROM w UNION ALL SELECT 2, w1, w2 FROM w WHERE w2 IS NOT NULL
 UNION ALL SELECT 3, w1 || ' ' || w2, w3 FROM w WHERE w3 IS NOT NULL),
c AS (SELECT k, ctx, word, count(*) AS n FROM e GROUP BY 1, 2, 3)
SELECT k, ctx, word, n, round(n / sum(n) OVER (PARTITION BY k, ctx), 9) AS p FROM c"""

# --- spelling

TERMS = f"qs AS (SELECT DISTINCT unnest({words(corpus('text'))}) AS term FROM conversations)"


def edit_list(t: str) -> str:
    at, gaps = f"range(1, length({t}) + 1)", f"range(1, length({t}) + 2)"
    return f"""list_distinct(list_concat(list_concat(
 list_transform({at}, lambda i: left({t}, i - 1) || substr({t}, i + 1)),
 list_transform(range(1, length({t})), lambda i: left({t}, i - 1) || substr({t}, i + 1, 1) || substr({t}, i, 1) || substr({t}, i + 2))),
 list_concat(flatten(list_transform({at}, lambda i: list_transform({LETTERS}, lambda c: left({t}, i - 1) || c || substr({t}, i + 1)))),
 flatten(list_transform({gaps}, lambda i: list_transform({LETTERS}, lambda c: left({t}, i - 1) || c || substr({t}, i)))))))"""


O["edits1"] = f"""WITH {TERMS}, e AS (SELECT term, {edit_list('term')} AS l FROM qs)
SELECT term, len(l) AS n_edits, list_min(l) AS first_edit, list_max(l) AS last_edit,
list_sum(list_transform(l, lambda x: length(x)))::BIGINT AS total_len FROM e"""
O["known_edits"] = f"""WITH {TERMS}, {DOCWORDS}, e AS (SELECT term, unnest({edit_list('term')}) AS word FROM qs)
SELECT term, word FROM e SEMI JOIN dw USING (word)"""
H = [f"('0x' || substr(md5(word), {i}, 8))::BIGINT" for i in (1, 9, 17)]
ERRORS = f"""{DOCWORDS}, ew AS (SELECT word, {H[0]} % 4 AS kind, ({H[1]} % (length(word) - 1) + 1)::INT AS i,
  chr(({H[2]} % 26 + 97)::INT) AS x FROM dw WHERE length(word) >= 2),
ep AS (SELECT error, max(word) AS correct FROM (SELECT word, left(word, i - 1) || CASE kind WHEN 0 THEN substr(word, i + 1)
  WHEN 1 THEN substr(word, i, 1) || substr(word, i) WHEN 2 THEN substr(word, i + 1, 1) || substr(word, i, 1) || substr(word, i + 2)
  ELSE x || substr(word, i + 1) END AS error FROM ew) WHERE error <> word GROUP BY 1),
ed AS (SELECT *, coalesce(list_min(list_filter(range(1, least(length(error), length(correct)) + 1),
  lambda k: substr(error, k, 1) <> substr(correct, k, 1))), least(length(error), length(correct)) + 1) AS d FROM ep),
et AS (SELECT *, CASE WHEN length(error) < length(correct) THEN 'deletion' WHEN length(error) > length(correct) THEN 'insertion'
  WHEN substr(error, d, 1) = substr(correct, d + 1, 1) AND substr(error, d + 1, 1) = substr(correct, d, 1)
   AND d < length(error) THEN 'transposition' ELSE 'substitution' END AS error_type,
  CASE WHEN d > 1 THEN substr(correct, d - 1, 1) ELSE '#' END AS b FROM ed),
ek AS (SELECT error, correct, error_type, CASE error_type WHEN 'deletion' THEN b || substr(correct, d, 1)
  WHEN 'insertion' THEN b || substr(error, d, 1) WHEN 'transposition' THEN substr(correct, d, 2)
  ELSE substr(error, d, 1) || substr(correct, d, 1) END AS key FROM et
  WHERE error_type IN ('insertion', 'transposition') OR substr(correct, d, 1) BETWEEN 'a' AND 'z'),
cl AS (SELECT error_type, key, count(*) AS n FROM ek GROUP BY 1, 2)"""
O["error_types"] = f"WITH {ERRORS} SELECT error, correct, error_type, key FROM ek"
O["confusion_learn"] = f"WITH {ERRORS} SELECT error_type, key, n FROM cl"
CHANNEL = f"""{ERRORS}, ewd AS (SELECT error AS word, 1 AS n FROM ep), {letter_cte('ewd', 'el')},
ch AS (SELECT error_type, key, cl.n, cl.n / coalesce(el.n, (SELECT count(*) FROM el)) AS p FROM cl LEFT JOIN el ON el.chars =
  CASE error_type WHEN 'insertion' THEN substr(key, 1, 1) WHEN 'substitution' THEN substr(key, 2, 1) ELSE key END)"""
O["error_proba"] = f"WITH {CHANNEL} SELECT error_type, key, n, round(p, 9) AS p FROM ch"
O["char_error_proba"] = f"""WITH {ERRORS}, hw AS (SELECT '#' || word AS word, n FROM dw), {letter_cte('hw', 'lc')}
SELECT error_type, key, cl.n, round(cl.n / coalesce(lc.n, (SELECT count(*) FROM lc)), 9) AS p
FROM cl LEFT JOIN lc ON lc.chars = key"""
# Edges of one error from every term to a possible intended string (te), and into every word from
# a possible misspelling (we); a run's last position names an edit, so each string appears once.
def spell(source: str) -> str:
    return f"""{CHANNEL}, chl AS (SELECT error_type AS et, substr(key, 1, 1) AS a, substr(key, 2, 1) AS b, p FROM ch WHERE p > 0),
st AS (SELECT DISTINCT unnest({words(corpus('text'))}) AS s FROM {source}),
sx AS (SELECT s, unnest(range(1, length(s) + 2)) AS i FROM st),
sp AS (SELECT s, i::INT AS i, CASE WHEN i > 1 THEN substr(s, i - 1, 1) ELSE '#' END AS b, substr(s, i, 1) AS c, substr(s, i + 1, 1) AS f FROM sx),
te AS (SELECT s AS term, left(s, i - 1) || chl.b || substr(s, i) AS mid, p FROM sp JOIN chl ON et = 'deletion' AND a = sp.b
   WHERE chl.b <> c AND chl.b BETWEEN 'a' AND 'z'
 UNION ALL SELECT s, left(s, i - 1) || substr(s, i + 1), p FROM sp JOIN chl ON et = 'insertion' AND a = sp.b AND chl.b = c WHERE c <> '' AND c <> f
 UNION ALL SELECT s, left(s, i - 1) || chl.b || substr(s, i + 1), p FROM sp JOIN chl ON et = 'substitution' AND a = c
   WHERE c <> '' AND chl.b <> c AND chl.b BETWEEN 'a' AND 'z'
 UNION ALL SELECT s, left(s, i - 1) || f || c || substr(s, i + 2), p FROM sp JOIN chl ON et = 'transposition' AND a = f AND chl.b = c
   WHERE f <> '' AND c <> f),
wx AS (SELECT word AS s, unnest(range(1, length(word) + 2)) AS i FROM dw),
wp AS (SELECT s, i::INT AS i, CASE WHEN i > 1 THEN substr(s, i - 1, 1) ELSE '#' END AS b, substr(s, i, 1) AS c, substr(s, i + 1, 1) AS f FROM wx),
we AS (SELECT s AS word, left(s, i - 1) || substr(s, i + 1) AS mid, p FROM wp JOIN chl ON et = 'deletion' AND a = wp.b AND chl.b = c
   WHERE c <> f AND c BETWEEN 'a' AND 'z'
 UNION ALL SELECT s, left(s, i - 1) || chl.b || substr(s, i), p FROM wp JOIN chl ON et = 'insertion' AND a = wp.b WHERE chl.b <> c
 UNION ALL SELECT s, left(s, i - 1) || chl.a || substr(s, i + 1), p FROM wp JOIN chl ON et = 'substitution' AND chl.b = c
   WHERE c BETWEEN 'a' AND 'z' AND chl.a <> c
 UNION ALL SELECT s, left(s, i - 1) || f || c || substr(s, i + 2), p FROM wp JOIN chl ON et = 'transposition' AND a = c AND chl.b = f
   WHERE f <> '' AND c <> f),
sc0 AS (SELECT term, mid AS word, p FROM te SEMI JOIN dw ON dw.word = te.mid
 UNION ALL SELECT term, we.word, te.p * we.p FROM te JOIN we USING (mid) WHERE mid <> '' AND we.word <> term),
cand AS (SELECT term, word, sum(p) AS score FROM sc0 GROUP BY 1, 2)"""


TURNS = "cv AS (SELECT conv_id * 1000 + turn AS post_id, text FROM conversations), "
PICK = "SELECT term, word, round(ln(score), 6) AS log_score FROM cand"
O["spell_candidates"] = f"WITH {spell('benchmark')} {PICK}"
O["spell_candidates_turns"] = f"WITH {TURNS}{spell('cv')} {PICK}"

KEEP, CHANGE = math.log(W.ALPHA), math.log(1 - W.ALPHA)


def window_p(source: str, keys: str) -> str:
    """(keys, lnp) of windows (keys, a, b, next) under the document model."""
    return f"""SELECT {keys}, ln(CASE WHEN lp.n > 0 THEN lp.n / lt.total
  ELSE 1 / (coalesce(lt.total, 0) + (SELECT count(*) FROM g)) END) AS lnp
 FROM (SELECT *, array_to_string(list_filter([a, b], lambda t: t NOT IN ({PUNCT})), ' ') AS wctx FROM {source}) x
 LEFT JOIN lp ON lp.ctx = x.wctx AND lp.last = x.next LEFT JOIN lt ON lt.ctx = x.wctx"""


def corrected(source: str, key: str, first: str = "") -> str:
    return f"""WITH {first}{spell(source)}, {TRI}, {PAIRS},
bs AS ({sentence_rows(source, key, normalize(corpus('text')))}),
sn AS (SELECT {key}, pos AS sent, sentence, {words('sentence')} AS ws, {split_each('sentence')} AS us FROM bs),
bu AS (SELECT {key}, sent, unnest(range(len(us))) AS spot, unnest(us) AS a FROM sn),
bw AS (SELECT {key}, sent, a, lead(a) OVER w AS b, lead(a, 2) OVER w AS next FROM bu WINDOW w AS (PARTITION BY {key}, sent ORDER BY spot)),
bx AS (SELECT * FROM bw WHERE next IS NOT NULL),
base AS (SELECT {key}, sent, sum(lnp) AS ll FROM ({window_p('bx', f'{key}, sent')}) GROUP BY 1, 2),
spots AS (SELECT {key}, sent, ws, unnest(range(1, len(ws) + 1)) AS spot, unnest(ws) AS term FROM sn),
z AS (SELECT term, sum(score) AS z FROM cand GROUP BY 1),
opt AS (SELECT {key}, sent, ws, spot, term AS word, NULL::DOUBLE AS share FROM spots
 UNION ALL SELECT {key}, sent, ws, spot, cand.word, ln(score) - ln(z) + ({CHANGE!r}) FROM spots JOIN cand USING (term) JOIN z USING (term)),
ow AS (SELECT *, unnest([spot - 2, spot - 1, spot]) AS st FROM opt),
ox AS (SELECT {key}, sent, spot, word, share, CASE WHEN st = spot THEN word ELSE ws[st] END AS a,
 CASE WHEN st + 1 = spot THEN word ELSE ws[st + 1] END AS b, CASE WHEN st + 2 = spot THEN word ELSE ws[st + 2] END AS next
 FROM ow WHERE st >= 1 AND st + 2 <= len(ws)),
os AS (SELECT {key}, sent, spot, word, share, sum(lnp) AS s FROM ({window_p('ox', f'{key}, sent, spot, word, share')}) GROUP BY ALL),
oa AS (SELECT o.{key}, o.sent, o.spot, o.word, o.share, coalesce(s, 0) AS s FROM opt o LEFT JOIN os ON o.{key} = os.{key}
 AND o.sent = os.sent AND o.spot = os.spot AND o.word = os.word AND o.share IS NOT DISTINCT FROM os.share),
old AS (SELECT {key}, sent, spot, s FROM oa WHERE share IS NULL),
alls AS (SELECT {key}, sent, sum(s) / 3 AS a FROM old GROUP BY 1, 2),
bp AS (SELECT {key}, sent, spot, word, round(share + s, 9) AS v FROM oa WHERE share IS NOT NULL
 QUALIFY row_number() OVER (PARTITION BY {key}, sent, spot ORDER BY round(share + s, 9) DESC, word DESC) = 1),
best AS (SELECT bp.{key}, bp.sent, bp.spot, bp.word, round(v - old.s, 9) AS v FROM bp JOIN old USING ({key}, sent, spot)
 QUALIFY row_number() OVER (PARTITION BY {key}, sent ORDER BY round(v - old.s, 9) DESC, bp.spot, bp.word DESC) = 1),
fin AS (SELECT sn.{key}, sn.sent, sentence, ws, spot, word,
 coalesce(round(best.v + a + ({CHANGE!r}), 9) > round(coalesce(ll, 0) + ({KEEP!r}), 9), false) AS better
 FROM sn LEFT JOIN base USING ({key}, sent) LEFT JOIN alls USING ({key}, sent) LEFT JOIN best USING ({key}, sent))
SELECT {key}, sent, CASE WHEN better THEN array_to_string(list_concat(list_concat(ws[:spot - 1], [word]), ws[spot + 1:]), ' ') || ' .'
 ELSE sentence END AS corrected, CASE WHEN better THEN ws[spot] END AS term, CASE WHEN better THEN word END AS word FROM fin"""


O["spell_correct"] = corrected("benchmark", "item_id")
O["spell_correct_turns"] = corrected("cv", "post_id", TURNS)

# --- splits

O["shuffle_order"] = f"""SELECT doc_id, row_number() OVER (ORDER BY md5({SEED} || '|' || doc_id), doc_id) AS rank FROM documents"""
O["tail_split"] = """SELECT doc_id, CASE WHEN r <= c - floor(c * 0.2) THEN 'train' ELSE 'test' END AS part FROM
(SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r, count(*) OVER () AS c FROM documents)"""
O["fold_sets"] = f"""WITH f AS (SELECT doc_id, quality, {fold_expr('doc_id', 10)} AS fold FROM labels),
r AS (SELECT *, row_number() OVER (PARTITION BY fold = 0 ORDER BY doc_id) AS r, count(*) OVER (PARTITION BY fold = 0) AS c FROM f)
SELECT doc_id, quality, fold, CASE WHEN fold = 0 THEN 'test' WHEN r <= c - floor(c * 0.1) THEN 'train' ELSE 'val' END AS part FROM r"""
O["kfold"] = f"SELECT doc_id, {fold_expr('doc_id', 10)} AS fold FROM documents"
O["stratified_kfold"] = f"SELECT doc_id, quality, {fold_expr('doc_id', 10, 'quality')} AS fold FROM labels"
O["random_holdout"] = f"""SELECT doc_id, CASE WHEN {draw32(SEED, 'doc_id::VARCHAR')} < {int(0.1 * (1 << 32))}
THEN 'test' ELSE 'train' END AS part FROM documents"""

ORACLES = O
