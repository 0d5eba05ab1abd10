"""The registered queries in the SQL of another engine.

Written from the definitions of the operators, with common table expressions
for the inputs that several queries share.
"""

from __future__ import annotations

from lettermill import domain as dm
from lettermill.plans import inputs as inp

# The literals of the query parse_id_forms; what they hold is written by hand in its SQL.
ID_FORMS = (
    "[{k}.9, -{k}]", "['{k}', \"{k}\"]", "({k}, 2)", "{{k}: 1}", "[None, {k}]", "[+{k}, - {k}]", "00{k}", "[1_000, {k}]",
    "[0x10, 0o17, 0b101, {k}]", "[({k}), 1]", "{k}; {k}", None, "['a', {k}]",
    "[{k}j, 1]", "[b'{k}', 1]", "['{k}' '1']", "[[{k}], 1]", "([{k}])", "{k} - 1", "- {k}", "[{k}.5, 'x', None]", "[None, 'x{k}']",
    "{{k}, 1}", "[{k}, [1, (2, {3: [4]})]", "[1, 2, 3 {k}]", "{k} + 1j", "set()", "[{k}, 1,]", "[True, {k}]",
)

WS = r"[\x09-\x0d\x1c-\x20\x{85}\p{Z}]"
NOT_WS = r"[^\x09-\x0d\x1c-\x20\x{85}\p{Z}]"
WORD = r"[\p{L}\p{N}_]{2,}"
EMAIL = inp.DOCUMENTS.code_pattern
CODE = dm.CODE_PATTERN


def q(text: str) -> str:
    """A string literal; line breaks are written as chr(10)."""
    parts = ["'" + p.replace("'", "''") + "'" for p in text.split("\n")]
    return parts[0] if len(parts) == 1 else "(" + " || chr(10) || ".join(parts) + ")"


def array(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def digits(digest: str, start: int, length: int, n: int) -> str:
    return f"(('0x' || substr({digest}, {start}, {length}))::BIGINT % {n})"


def pick(slot: str, index: str, n: int, seed: int = 42) -> str:
    return digits(f"md5('{seed}:{slot}:' || ({index})::VARCHAR)", 1, 8, n)


def choose(options, slot: str, index: str) -> str:
    return f"{array(options)}[{pick(slot, index, len(options))} + 1]"


def fill(template: str, slots: dict[str, str]) -> str:
    for name, value in slots.items():
        template = f"replace({template}, '{{{name}}}', {value})"
    return template


def clean(text: str) -> str:
    collapsed = f"trim(regexp_replace(coalesce({text}, ''), '{WS}+', ' ', 'g'))"
    return f"regexp_replace({collapsed}, ' ([,.!?;:])', '\\1', 'g')"


def r6(expression: str, name: str) -> str:
    return f"round(({expression})::DOUBLE, 6) AS {name}"


def codes_sql(index: str, most: int, prefixes=None) -> str:
    """A list of generated codes."""
    size = f"{pick('codes', index, most)} + 1"
    h = f"md5('42:code:' || ({index})::VARCHAR || ':' || j::VARCHAR)"
    if prefixes is None:
        head = f"'F' || ({digits('h', 1, 6, 90)} + 10)::VARCHAR"
    else:
        head = f"{array(prefixes)}[{digits('h', 1, 6, len(prefixes))} + 1]"
    code = (
        f"{head} || '.' || ({digits('h', 7, 6, 90)} + 10)::VARCHAR || '.' || ({digits('h', 13, 6, 90)} + 10)::VARCHAR"
        f" || '.' || {digits('h', 19, 6, 10)}::VARCHAR || '.' || ({digits('h', 25, 6, 900)} + 100)::VARCHAR"
    )
    return f"list_transform(list_transform(range(1, {size} + 1), lambda j: {h}), lambda h: {code})"


def class_0_sql(index: str) -> str:
    return fill(
        choose(dm.CLASS_0_TEMPLATES, "template", index),
        {
            "company": choose(dm.TEMPLATE_COMPANIES, "company", index),
            "services": choose(dm.SERVICES, "services", index),
            "patient_info": choose(dm.PATIENT_INFO, "patient_info", index),
            "patient_action": choose(dm.PATIENT_ACTIONS, "patient_action", index),
            "program_type": choose(dm.PROGRAM_TYPES, "program_type", index),
        },
    )


def class_1_sql(index: str) -> str:
    return fill(
        choose(dm.CLASS_1_TEMPLATES, "template", index),
        {
            "company": choose(dm.TEMPLATE_COMPANIES, "company", index),
            "service_codes": f"array_to_string({codes_sql(index, dm.CODES_PER_LETTER)}, chr(10))",
            "diagnosis": choose(dm.DIAGNOSES, "diagnosis", index),
            "patient_info": choose(dm.PATIENT_INFO, "patient_info", index),
        },
    )


# --- shared inputs ---------------------------------------------------------------------

DOC = """doc AS (
  SELECT d.doc_id::VARCHAR AS letter_id, d.text AS guarantee_letter_text, l.quality AS class, d.source AS company
  FROM documents d LEFT JOIN labels l USING (doc_id))"""
LABELLED = f"""{DOC},
labelled AS (SELECT * FROM doc WHERE class IS NOT NULL)"""

LET = f"""lines AS (
  SELECT l_orderkey, l_partkey, 'F' || (10 + l_partkey % 90) || '.' || (10 + l_suppkey % 90) || '.' ||
    (10 + l_orderkey % 90) || '.' || (l_linenumber % 10) || '.' || (100 + (l_partkey * 7) % 900) AS code
  FROM lineitem),
all_codes AS (
  SELECT l_orderkey, string_agg(code, chr(10) ORDER BY code) AS codes FROM (SELECT DISTINCT l_orderkey, code FROM lines) GROUP BY 1),
extremes AS (SELECT l_orderkey, min(l_partkey) AS low, max(l_partkey) AS high FROM lines GROUP BY 1),
picked AS (
  SELECT o_orderkey AS k, ({pick('cls', 'o_orderkey', 162)} < 118)::INTEGER AS class,
    {pick('noise', 'o_orderkey', 20)} = 0 AS flipped,
    {choose(inp.LETTER_COMPANIES, 'co', 'o_orderkey')} AS name,
    {choose(inp.CODED_BODIES, 'tpl', 'o_orderkey')} AS coded,
    {choose(inp.PLAIN_BODIES, 'tpl', 'o_orderkey')} AS plain,
    {pick('ids', 'o_orderkey', 4)} AS id_form, coalesce(codes, '') AS codes, low, high
  FROM orders LEFT JOIN all_codes t ON t.l_orderkey = o_orderkey LEFT JOIN extremes e ON e.l_orderkey = o_orderkey),
letters AS (
  SELECT k::VARCHAR AS letter_id,
    name || chr(10) || chr(10) || CASE WHEN (class = 1) <> flipped THEN replace(coded, '{{codes}}', codes) ELSE plain END
      AS guarantee_letter_text,
    class,
    CASE WHEN low IS NULL THEN NULL WHEN id_form = 0 THEN '[' || low || ', ' || high || ']'
      WHEN id_form = 1 THEN low::VARCHAR WHEN id_form = 2 THEN 'id ' || low || '; ' || high ELSE '[]' END
      AS service_ids_list
  FROM picked)"""


def prep(source: str, pattern: str) -> str:
    ids = (
        ", CASE WHEN service_ids_list IS NULL THEN ''"
        " ELSE array_to_string(regexp_extract_all(service_ids_list, '[0-9]+'), '|') END AS parsed_service_ids"
        if source == "letters"
        else ""
    )
    return f"""cleaned AS (SELECT *, {clean('guarantee_letter_text')} AS text_cleaned FROM {source}),
prep AS (
  SELECT *, regexp_extract_all(text_cleaned, '{pattern}') AS codes,
    regexp_matches(text_cleaned, '{pattern}') AS has_service_codes,
    len(regexp_extract_all(text_cleaned, '{pattern}'))::INTEGER AS num_service_codes,
    CASE WHEN regexp_matches(text_cleaned, '(?i)Согаз|СОГАЗ') THEN 'Согаз'
      WHEN regexp_matches(text_cleaned, '(?i)Ингосстрах|ИНГОССТРАХ') THEN 'Ингосстрах' ELSE 'Другая' END AS insurance_company,
    length(text_cleaned)::INTEGER AS text_length,
    len(regexp_extract_all(text_cleaned, '{NOT_WS}+'))::INTEGER AS num_words{ids}
  FROM cleaned)"""


PREP = LET + ",\n" + prep("letters", CODE)
DPREP = DOC + ",\n" + prep("doc", EMAIL)
PRD = """prd AS (
  SELECT (l_returnflag = 'R')::INTEGER AS y, (l_discount * 10 + l_tax > 0.6::DOUBLE)::INTEGER AS p,
    (l_discount > 0.05::DOUBLE)::INTEGER AS q, round(l_discount * 8 + l_tax * 2, 2) AS score FROM lineitem)"""
PAIR = """pairs AS (
  SELECT l_suppkey, avg(((l_discount > 0.05::DOUBLE) = (l_returnflag = 'R'))::INTEGER::DOUBLE) AS a,
    avg(((l_tax > 0.04::DOUBLE) = (l_returnflag = 'R'))::INTEGER::DOUBLE) AS b FROM lineitem GROUP BY 1)"""


def cells_of(source: str, by: str = "") -> str:
    group = f" GROUP BY {by}" if by else ""
    head = f"{by}, " if by else ""
    return f"""cells AS (
  SELECT {head}count(*) FILTER (y = 0 AND p = 0) AS tn, count(*) FILTER (y = 0 AND p = 1) AS fp,
    count(*) FILTER (y = 1 AND p = 0) AS fn, count(*) FILTER (y = 1 AND p = 1) AS tp,
    avg(score) AS mean_score FROM {source}{group}),
rates AS (
  SELECT *, (tn + fp + fn + tp)::DOUBLE AS n,
    coalesce(tn / nullif(tn + fn, 0)::DOUBLE, 0) AS p0, coalesce(tn / nullif(tn + fp, 0)::DOUBLE, 0) AS r0,
    coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS p1, coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS r1 FROM cells),
scores AS (
  SELECT *, coalesce(2 * p0 * r0 / nullif(p0 + r0, 0), 0) AS f0, coalesce(2 * p1 * r1 / nullif(p1 + r1, 0), 0) AS f1,
    (tn + tp) / n AS accuracy FROM rates),
metrics AS (
  SELECT *, (p0 * (tn + fp) + p1 * (tp + fn)) / n AS precision_weighted, (r0 * (tn + fp) + r1 * (tp + fn)) / n AS recall_weighted,
    (f0 * (tn + fp) + f1 * (tp + fn)) / n AS f1_weighted, (p0 + p1) / 2 AS precision_macro, (r0 + r1) / 2 AS recall_macro,
    (f0 + f1) / 2 AS f1_macro,
    (tp::DOUBLE * tn - fp::DOUBLE * fn) / sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)) AS mcc FROM scores)"""


RUN_SETTINGS = ", ".join(f"({q(i)}, {q(f)}, {s}, {t}::DOUBLE)" for i, f, s, t in inp.RUNS)
RUN = f"""{PRD},
settings(run_id, family, size, threshold) AS (VALUES {RUN_SETTINGS}),
judged AS (
  SELECT run_id, family, size::INTEGER AS size, y, (score > threshold)::INTEGER AS p, score FROM prd CROSS JOIN settings),
{cells_of('judged', 'run_id, family, size')},
runs AS (
  SELECT *, (n + size)::BIGINT AS train_size, n::BIGINT AS test_size,
    CASE WHEN family = 'generated' THEN mean_score END AS mean_quality FROM metrics),
best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY f1_weighted DESC, size, run_id) AS place FROM runs)
  WHERE place = 1),
base AS (SELECT accuracy AS b_accuracy, f1_weighted AS b_f1_weighted, precision_weighted AS b_precision_weighted,
    recall_weighted AS b_recall_weighted FROM best WHERE family = 'baseline')"""
HEADLINE = ("accuracy", "f1_weighted", "precision_weighted", "recall_weighted")


def unpivoted(source: str, keep: str, columns) -> str:
    return " UNION ALL ".join(f"SELECT {keep}, '{c}' AS metric, {c} AS value FROM {source}" for c in columns)


def grams(high: int, k: int, source: str = DPREP) -> str:
    """n-gram occurrences, vocabulary, and normalised weights of the prepared letters."""
    levels = ["SELECT letter_id, class, w1 AS term FROM placed"]
    if high > 1:
        levels += [
            "SELECT letter_id, class, w1 || ' ' || w2 FROM placed WHERE w2 IS NOT NULL",
            "SELECT letter_id, class, w1 || ' ' || w2 || ' ' || w3 FROM placed WHERE w3 IS NOT NULL",
        ]
    return f"""{source},
tokens AS (SELECT letter_id, class, regexp_extract_all(lower(text_cleaned), '{WORD}') AS words FROM prep),
words AS (SELECT letter_id, class, unnest(words) AS w1, unnest(range(1, len(words) + 1)) AS i FROM tokens),
placed AS (
  SELECT letter_id, class, w1, lead(w1, 1) OVER w AS w2, lead(w1, 2) OVER w AS w3 FROM words
  WINDOW w AS (PARTITION BY letter_id ORDER BY i)),
grams AS ({' UNION ALL '.join(levels)}),
tf AS (SELECT letter_id, class, term, count(*) AS tf FROM grams GROUP BY ALL),
totals AS (SELECT count(*) AS n FROM prep),
vocabulary AS (
  SELECT term, sum(tf)::BIGINT AS term_count, count(*) AS document_count FROM tf GROUP BY term
  ORDER BY term_count DESC, term LIMIT {k}),
idfs AS (SELECT *, ln((1 + n)::DOUBLE / (1 + document_count)) + 1 AS idf FROM vocabulary, totals),
raw AS (SELECT letter_id, class, term, tf * idf AS w FROM tf JOIN idfs USING (term)),
lengths AS (SELECT letter_id, sqrt(sum(w * w)) AS l FROM raw GROUP BY 1),
weights AS (SELECT letter_id, class, term, w / l AS weight FROM raw JOIN lengths USING (letter_id))"""


def phrases(lists) -> str:
    rows = [f"({c}, {q(p)})" for c, ps in lists for p in ps]
    return f"phrases(list_class, keyword) AS (VALUES {', '.join(rows)})"


def keyword_sql(prefix: str, lists) -> str:
    return f"""WITH {prefix}, {phrases(lists)},
hits AS (
  SELECT list_class, keyword, count(*) AS count, count(*) FILTER (class = 0) AS c0, count(*) FILTER (class = 1) AS c1
  FROM prep, phrases WHERE regexp_matches(text_cleaned, '(?i)' || regexp_escape(keyword)) GROUP BY ALL)"""


def long_rows(section: str, sql: str, labels, values) -> str:
    """A section's result as (section, item, measure, value) rows."""
    item = "concat_ws('|', " + ", ".join(f"coalesce({c}::VARCHAR, '-')" for c in labels) + ")" if labels else "''"
    parts = [f"SELECT '{section}' AS section, {item} AS item, '{v}' AS measure, round({v}::DOUBLE, 6) AS value FROM s" for v in values]
    return f"SELECT * FROM (WITH s AS ({sql}) " + " UNION ALL ".join(parts) + ")"


def top_terms_sql(source: str) -> str:
    return f"""WITH {source}, m AS (SELECT term, sum(weight) / any_value(n) AS mean FROM weights, totals GROUP BY 1)
      SELECT term, {r6('mean', 'mean_weight')} FROM m ORDER BY round(mean, 12) DESC, term LIMIT 20"""


def top_terms_by_class_sql(source: str) -> str:
    return f"""WITH {source}, sizes AS (SELECT class, count(*) AS k FROM prep WHERE class IS NOT NULL GROUP BY 1),
      m AS (SELECT class, term, sum(weight) / any_value(k) AS mean FROM weights JOIN sizes USING (class) GROUP BY ALL)
      SELECT class, term, {r6('mean', 'mean_weight')}, position FROM (SELECT *, row_number() OVER (
        PARTITION BY class ORDER BY round(mean, 12) DESC, term)::INTEGER AS position FROM m) WHERE position <= 10"""


DOC_LISTS = ((0, inp.DOCUMENTS.class_0_phrases), (1, inp.DOCUMENTS.class_1_phrases))
LET_LISTS = ((0, dm.CLASS_0_PHRASES), (1, dm.CLASS_1_PHRASES))
FREQUENCY = " SELECT list_class::INTEGER AS list_class, keyword, count FROM hits"
PURITY = f""" SELECT list_class::INTEGER AS list_class, keyword, c0 + c1 AS total_occurrences,
  {r6('c0 / (c0 + c1)::DOUBLE', 'class_0_ratio')}, {r6('c1 / (c0 + c1)::DOUBLE', 'class_1_ratio')},
  (CASE WHEN c0 > c1 THEN 0 ELSE 1 END)::INTEGER AS preferred_class FROM hits WHERE c0 + c1 > 0"""


def features_sql(source: str, pattern: str, companies, zero, one) -> str:
    t = "coalesce(guarantee_letter_text, '')"

    def score(keys):
        return " + ".join(f"contains(lower({t}), {q(k)})::INTEGER" for k in keys)

    return f"""features AS (
  SELECT letter_id, class, regexp_matches({t}, '{pattern}')::INTEGER AS has_codes,
    len(regexp_extract_all({t}, '{pattern}'))::INTEGER AS num_codes, length({t})::INTEGER AS length,
    len(regexp_extract_all({t}, '{NOT_WS}+'))::INTEGER AS words,
    contains(lower({t}), {q(companies[0])})::INTEGER AS has_company_1,
    contains(lower({t}), {q(companies[1])})::INTEGER AS has_company_2,
    ({score(zero)})::INTEGER AS class_0_score, ({score(one)})::INTEGER AS class_1_score FROM {source})"""


FEATURES = ("has_codes", "num_codes", "length", "words", "has_company_1", "has_company_2", "class_0_score", "class_1_score")
LET_FEATURES = features_sql("letters", CODE, dm.FEATURE_COMPANIES, dm.FEATURE_CLASS_0, dm.FEATURE_CLASS_1)


def scaled_sql(name: str) -> str:
    return f"coalesce(({name} - avg({name}) OVER ()) / nullif(stddev_pop({name}) OVER (), 0), 0)"


SYNTHETIC = f"""counts AS (
  SELECT count(*) AS n, count(*) FILTER (class = 0) AS c0 FROM letters),
sizes AS (SELECT n AS size, trunc(n * (c0 / n::DOUBLE))::BIGINT AS s0 FROM counts),
synthetic AS (
  SELECT 'synthetic_0_' || i AS letter_id, {class_0_sql("'0:' || i")} AS guarantee_letter_text, 0 AS class
  FROM (SELECT unnest(range(s0)) AS i FROM sizes)
  UNION ALL
  SELECT 'synthetic_1_' || i, {class_1_sql("'1:' || i")}, 1
  FROM (SELECT unnest(range(size - s0)) AS i FROM sizes))"""

REQUESTS = f"""asked AS (
  SELECT o_orderkey::VARCHAR AS request_id, ({pick('cls', 'o_orderkey', 162)} < 118)::INTEGER AS class,
    'Письмо ' || o_orderkey || chr(10) || o_orderpriority AS letter_text,
    {pick('quality', 'o_orderkey', 1000)} / 1000.0::DOUBLE AS quality, {pick('kind', 'o_orderkey', 10)} AS kind FROM orders)"""


def letters_of_requests(source: str) -> str:
    """Letters of rows with request_id, class, kind, letter_text and quality (kind null: no answer)."""
    codes = codes_sql("request_id", dm.REQUEST_CODES_PER_LETTER, dm.REQUEST_CODE_PREFIXES)
    company = choose(dm.REQUEST_COMPANIES, "company", "request_id")
    slots = {"company": company, "service_codes": f"array_to_string({codes}, chr(10))"}
    return f"""made AS (
  SELECT (CASE WHEN kind > 2 THEN 'synthetic_llm_' ELSE 'fallback_' END) || request_id AS letter_id,
    CASE WHEN kind > 2 THEN letter_text WHEN class = 0 THEN {fill(choose(dm.FALLBACK_CLASS_0, 'fallback', 'request_id'), {'company': company})}
      ELSE {fill(choose(dm.FALLBACK_CLASS_1, 'fallback', 'request_id'), slots)} END AS guarantee_letter_text,
    class, CASE WHEN kind > 2 THEN quality ELSE 0.8::DOUBLE END AS quality_score,
    CASE WHEN kind > 2 THEN 'as asked' ELSE {q(dm.FALLBACK_REASONING)} END AS reasoning,
    CASE WHEN kind > 2 THEN 'llm' ELSE 'fallback' END AS generation_method FROM {source})"""


MADE = REQUESTS + ",\n" + letters_of_requests("asked")

SPLIT = pick("split", "letter_id", 10)

# Two-sided tails by Simpson's rule over the densities.
SIMPSON = """steps AS (SELECT unnest(range(0, 20001)) AS i),
points AS (SELECT i, CASE WHEN i IN (0, 20000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS f FROM steps)"""

RANKED_PAIRS = f"""{PAIR},
diffs AS (SELECT round(a - b, 12) AS d FROM pairs),
sizes AS (
  SELECT abs(d) AS size, count(*) AS n, count(*) FILTER (d > 0) AS positive FROM diffs WHERE d <> 0 GROUP BY 1),
mid AS (
  SELECT *, coalesce(sum(n) OVER (ORDER BY size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2.0::DOUBLE
    AS midrank FROM sizes)"""


def oracle_queries() -> dict[str, str]:
    coefficients = "[" + ", ".join(f"{round(((i * 37) % 17 - 8) / 8, 4)}::DOUBLE" for i in range(64)) + "]"
    out: dict[str, str] = {}

    # sources and sinks
    out["read_training_letters"] = f"WITH {DOC} SELECT letter_id, guarantee_letter_text, class::VARCHAR AS class FROM doc WHERE {SPLIT} < 7"
    out["read_test_letters"] = f"WITH {DOC} SELECT letter_id, guarantee_letter_text, class::VARCHAR AS class FROM doc WHERE {SPLIT} >= 7"
    out["read_service_catalogue"] = """SELECT p_partkey AS service_id,
      'F' || (10 + p_partkey % 90) || '.' || (100 + (p_partkey * 7) % 900) AS ServiceCode, p_name AS ServiceName FROM part"""
    out["ratio_preserving_set"] = f"WITH {LET}, {SYNTHETIC} SELECT * FROM synthetic"
    edges = """CASE o_orderkey % 7 WHEN 0 THEN '  lead ' || o_orderkey WHEN 1 THEN 'trail ' || o_orderkey || ' ' || chr(10)
      WHEN 2 THEN 'say "' || o_orderkey || '", then, end' WHEN 3 THEN 'two' || chr(13) || chr(10) || 'lines ' || o_orderkey
      WHEN 4 THEN '\\' || o_orderkey || '\\' WHEN 5 THEN '' END"""
    out["write_letters_csv"] = out["ratio_preserving_set"] + f" UNION ALL SELECT 'edge_' || o_orderkey, {edges}, 0 FROM orders"
    loaded = f"""SELECT CASE WHEN {SPLIT} < 7 THEN 'train' ELSE 'test' END AS part, letter_id AS id, class::VARCHAR AS class,
        md5(coalesce(guarantee_letter_text, 'none')) AS text FROM doc
      UNION ALL SELECT 'services', p_partkey::VARCHAR, NULL,
        md5('F' || (10 + p_partkey % 90) || '.' || (100 + (p_partkey * 7) % 900) || p_name) FROM part"""
    out["load_three_tables"] = f"WITH {DOC}, loaded AS ({loaded}) SELECT k AS kind, loaded.* FROM loaded, unnest(['parquet', 'json', 'csv']) u(k)"
    table = f"""SELECT CASE family WHEN 'baseline' THEN 'Базовая модель (только реальные данные)'
        WHEN 'synthetic' THEN 'Шаблонные синтетические данные (' || size || ')'
        ELSE 'LLM синтетические данные (' || size || ')' END AS experiment, train_size, size AS synthetic_size,
      {r6('accuracy', 'accuracy')}, {r6('f1_weighted', 'f1')}, {r6('precision_weighted', 'precision')},
      {r6('recall_weighted', 'recall')} FROM runs WHERE family <> 'classifier'"""
    out["write_results_table"] = f"WITH {RUN} {table}"
    out["results_table"] = out["write_results_table"]
    out["write_summary_report"] = f"""WITH {RUN},
      lines AS (SELECT family, size, printf('%.3f', f1_weighted) AS f1, printf('%.3f', accuracy) AS acc,
        printf('%.1f', (f1_weighted - b_f1_weighted) / b_f1_weighted * 100) AS gain, printf('%.3f', mean_quality) AS quality
        FROM best, base)
      SELECT unnest(['# Отчет по экспериментам классификации страховых писем', 'Дата проведения: 20240101_000000', '', '## Сводка результатов', '']) AS line
      UNION ALL SELECT unnest(['**Базовая модель (только реальные данные):**', '- F1-score: ' || f1, '- Accuracy: ' || acc, ''])
        FROM lines WHERE family = 'baseline'
      UNION ALL SELECT unnest(['**Лучший результат с синтетическими данными:**', '- Размер синтетической выборки: ' || size,
        '- F1-score: ' || f1, '- Улучшение: +' || gain || '%', '']) FROM lines WHERE family = 'synthetic'
      UNION ALL SELECT unnest(['**Лучший результат с LLM данными:**', '- Размер LLM выборки: ' || size, '- F1-score: ' || f1,
        '- Средняя оценка качества: ' || quality, '']) FROM lines WHERE family = 'generated'"""
    out["latest_run"] = f"""WITH {RUN} SELECT run_id, family, size, {r6('f1_weighted', 'f1_weighted')},
      '20240102_000000' AS experiment FROM runs"""

    out["latest_committed_run"] = f"""WITH {RUN} SELECT run_id, family, size, {r6('f1_weighted', 'f1_weighted')},
      2::BIGINT AS version, '20240101_000000' AS run_label FROM runs"""

    # row-wise text functions
    out["clean_text"] = f"WITH {DPREP} SELECT letter_id, text_cleaned FROM prep"
    out["code_presence"] = f"WITH {PREP} SELECT letter_id, has_service_codes::INTEGER AS has_service_codes FROM prep"
    out["code_presence_documents"] = f"WITH {DPREP} SELECT letter_id, has_service_codes::INTEGER AS has_service_codes FROM prep"
    out["extract_codes"] = f"WITH {PREP} SELECT letter_id, array_to_string(codes, '|') AS codes FROM prep"
    out["count_codes"] = f"WITH {PREP} SELECT letter_id, num_service_codes FROM prep"
    out["insurance_company"] = f"WITH {PREP} SELECT letter_id, insurance_company FROM prep"
    out["text_length"] = f"WITH {DPREP} SELECT letter_id, text_length FROM prep"
    out["word_count"] = f"WITH {DPREP} SELECT letter_id, num_words FROM prep"
    out["parse_id_lists"] = f"WITH {PREP} SELECT letter_id, parsed_service_ids AS service_ids FROM prep"
    ids = ["k || '|' || m", "k || '|' || k", "''", "''", "''", "k || '|' || m", "k", "'1000|' || k", "'16|15|5|' || k", "k || '|1'", "k || '|' || k", "''", "k"]
    ids += ["''", "k || '|1'", "k || '1'", "''", "k", "k || '|1'", "m", "k || '|5'", "''"]
    ids += ["''", "k || '|1|2|3|4'", "'1|2|3|' || k", "''", "''", "k || '|1'", "'1|' || k"]
    raws = " ".join(f"WHEN {i} THEN replace({q(f)}, '{{k}}', k)" for i, f in enumerate(ID_FORMS) if f)
    expected = " ".join(f"WHEN {i} THEN {e}" for i, e in enumerate(ids))
    out["parse_id_forms"] = f"""SELECT o_orderkey, CASE o_orderkey % {len(ids)} {raws} END AS raw,
      CASE o_orderkey % {len(ids)} {expected} END AS ids FROM (SELECT o_orderkey, o_orderkey::VARCHAR AS k, (-o_orderkey)::VARCHAR AS m FROM orders)"""
    out["code_prefix"] = f"""WITH {PREP} SELECT DISTINCT code, substr(code, 1, 3) AS prefix
      FROM (SELECT unnest(codes) AS code FROM prep)"""
    out["diagnosis_codes"] = rf"""WITH {LET} SELECT letter_id,
      array_to_string(regexp_extract_all(guarantee_letter_text, '[A-Z]\d{{2}}\.?\d*'), '|') AS diagnoses FROM letters"""
    flat = """text_cleaned, array_to_string(codes, '|') AS service_codes_list, has_service_codes::INTEGER AS has_service_codes,
      num_service_codes, insurance_company, text_length, num_words"""
    out["preprocess"] = f"""WITH {PREP} SELECT letter_id, guarantee_letter_text, class, service_ids_list, {flat},
      parsed_service_ids FROM prep"""
    out["preprocess_documents"] = f"WITH {DPREP} SELECT letter_id, guarantee_letter_text, class::VARCHAR AS class, company, {flat} FROM prep"
    out["handcrafted"] = f"WITH {LET}, {LET_FEATURES} SELECT letter_id, {', '.join(FEATURES)} FROM features"
    doc_features = features_sql("doc", EMAIL, ("src", "the"), ("the", "of"), ("und", "le"))
    out["handcrafted_documents"] = f"WITH {DOC}, {doc_features} SELECT letter_id, {', '.join(FEATURES)} FROM features"
    out["model_text"] = f"""WITH {DOC} SELECT letter_id,
      regexp_replace(coalesce(guarantee_letter_text, ''), '^{WS}+|{WS}+\\z', '', 'g') AS model_text FROM doc"""
    out["keyword_substring"] = f"WITH {DOC} SELECT letter_id, contains(lower(guarantee_letter_text), 'und')::INTEGER AS found FROM doc"
    out["phrase_contains"] = f"WITH {DPREP} SELECT letter_id, regexp_matches(text_cleaned, '(?i)and the')::INTEGER AS found FROM prep"
    out["metric_format"] = f"WITH {RUN} SELECT run_id, printf('%.3f', f1_weighted) AS f1_text FROM runs"
    out["run_label"] = "SELECT strftime(max(o_orderdate), '%Y%m%d_%H%M%S') AS run_label FROM orders"

    # filters
    out["rows_of_class"] = f"WITH {DOC} SELECT letter_id, class FROM doc WHERE class = 0"
    out["rows_of_company"] = f"WITH {PREP} SELECT letter_id, insurance_company FROM prep WHERE insurance_company = 'Согаз'"
    out["letters_with_codes"] = f"WITH {PREP} SELECT letter_id, num_service_codes FROM prep WHERE num_service_codes > 0"
    out["missing_or_empty_text"] = f"""WITH {LET} SELECT letter_id,
      CASE WHEN service_ids_list IS NULL THEN 'missing' ELSE 'empty' END AS problem
      FROM letters WHERE service_ids_list IS NULL OR service_ids_list = '[]'"""
    out["label_contradictions"] = f"""WITH {PREP} SELECT letter_id, class,
      CASE class WHEN 1 THEN 'class_1_without_codes' ELSE 'class_0_with_codes' END AS problem
      FROM prep WHERE (class = 1) <> has_service_codes"""

    # joins
    out["service_map"] = """SELECT p_size::BIGINT::INTEGER AS service_id, arg_max(p_brand, p_partkey) AS code,
      arg_max(p_name, p_partkey) AS name FROM part GROUP BY 1"""
    out["resolve_service_ids"] = f"""WITH {LET},
      ids AS (SELECT letter_id, regexp_extract_all(coalesce(service_ids_list, ''), '[0-9]+') AS ids FROM letters),
      wanted AS (SELECT letter_id, unnest(ids)::BIGINT AS id, unnest(range(len(ids))) AS i FROM ids),
      named AS (SELECT letter_id, i, concat_ws(':', id::VARCHAR,
          'F' || (10 + p_partkey % 90) || '.' || (100 + (p_partkey * 7) % 900), p_name) AS s
        FROM wanted LEFT JOIN part ON p_partkey = id)
      SELECT l.letter_id, coalesce(string_agg(s, '|' ORDER BY i), '') AS services
      FROM letters l LEFT JOIN named USING (letter_id) GROUP BY 1"""

    # aggregations
    out["class_value_counts"] = f"WITH {LABELLED} SELECT class, count(*) AS count FROM labelled GROUP BY 1"
    out["company_value_counts"] = f"WITH {PREP} SELECT insurance_company, count(*) AS count FROM prep GROUP BY 1"
    out["code_count_value_counts"] = f"WITH {PREP} SELECT num_service_codes, count(*) AS count FROM prep GROUP BY 1"
    out["code_counts_by_value"] = out["code_count_value_counts"]
    out["class_shares"] = f"""WITH {LABELLED}, c AS (SELECT count(*) AS total, count(*) FILTER (class = 0) AS class_0,
        count(*) FILTER (class = 1) AS class_1 FROM labelled)
      SELECT *, {r6('class_0 * 100.0 / total', 'class_0_percent')}, {r6('class_1 * 100.0 / total', 'class_1_percent')},
        {r6('class_0 / class_1::DOUBLE', 'imbalance_ratio')} FROM c"""
    quality = f"""SELECT count(*) AS total_samples, count(*) FILTER (guarantee_letter_text IS NULL) AS missing_texts,
      count(*) FILTER (guarantee_letter_text = '') AS empty_texts, {r6('avg(text_length)', 'avg_text_length')},
      {r6('avg(num_words)', 'avg_words')}, count(*) FILTER (class = 1 AND NOT has_service_codes) AS class_1_without_codes,
      count(*) FILTER (class = 0 AND has_service_codes) AS class_0_with_codes,
      count(*) FILTER ((class = 1) <> has_service_codes) AS potential_labeling_errors FROM prep"""
    out["data_quality"] = f"WITH {PREP} {quality}"
    out["data_quality_documents"] = f"WITH {DPREP} {quality}"
    general = f"""SELECT CASE grouping(class) WHEN 1 THEN 'overall' ELSE class::VARCHAR END AS scope, count(*) AS sample_count,
      {r6('avg(text_length)', 'avg_text_length')}, {r6('avg(num_words)', 'avg_words')} FROM prep GROUP BY ROLLUP (class) HAVING grouping(class) = 1 OR class IS NOT NULL"""
    out["general_statistics"] = f"WITH {DPREP} {general}"
    profile = f"""SELECT class, count(*) AS sample_count, {r6('avg(has_service_codes::INTEGER)', 'has_service_codes_ratio')},
      {r6('avg(num_service_codes)', 'avg_service_codes')}, {r6('avg(text_length)', 'length_mean')},
      {r6('stddev_samp(text_length)', 'length_std')}, min(text_length) AS length_min, max(text_length) AS length_max
      FROM prep WHERE class IS NOT NULL GROUP BY class"""
    out["class_profile"] = f"WITH {DPREP} {profile}"
    out["class_profile_letters"] = f"WITH {PREP} {profile}"
    out["class_company_counts"] = f"WITH {PREP} SELECT class, insurance_company, count(*) AS count FROM prep GROUP BY ALL"
    differences = f"""SELECT
      {r6('avg(has_service_codes::INTEGER) FILTER (class = 0)', 'class_0_with_codes')},
      {r6('avg(has_service_codes::INTEGER) FILTER (class = 1)', 'class_1_with_codes')},
      {r6('avg(text_length) FILTER (class = 1) - avg(text_length) FILTER (class = 0)', 'text_length_difference')} FROM prep"""
    out["class_differences"] = f"WITH {PREP} {differences}"
    companies = f"""SELECT insurance_company, count(*) AS sample_count,
      count(*) FILTER (class = 0) AS class_0, count(*) FILTER (class = 1) AS class_1,
      {r6('avg(text_length)', 'avg_text_length')}, {r6('avg(has_service_codes::INTEGER)', 'has_service_codes_ratio')}
      FROM prep GROUP BY 1"""
    out["company_profile"] = f"WITH {PREP} {companies}"
    out["code_statistics"] = f"""WITH {PREP} SELECT count(DISTINCT code) AS total_unique_codes, count(*) AS total_code_occurrences
      FROM (SELECT unnest(codes) AS code FROM prep)"""
    out["top_codes"] = f"""WITH {PREP} SELECT code, count(*) AS count FROM (SELECT unnest(codes) AS code FROM prep)
      GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"""
    out["top_prefixes"] = f"""WITH {PREP} SELECT substr(code, 1, 3) AS prefix, count(*) AS count
      FROM (SELECT unnest(codes) AS code FROM prep) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"""
    per_letter = f"""SELECT count(*) FILTER (num_service_codes > 0) AS letters_with_codes,
      {r6('avg(num_service_codes) FILTER (num_service_codes > 0)', 'mean_codes')}, max(num_service_codes) AS max_codes FROM prep"""
    out["codes_per_letter"] = f"WITH {PREP} {per_letter}"
    out["codes_by_class"] = f"""WITH {PREP} SELECT class, count(DISTINCT code) AS unique_codes, count(code) AS total_occurrences
      FROM (SELECT class, unnest(codes) AS code FROM prep) GROUP BY 1"""
    out["top_codes_by_class"] = f"""WITH {PREP}, c AS (
        SELECT class, code, count(*) AS count FROM (SELECT class, unnest(codes) AS code FROM prep) GROUP BY ALL)
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY class ORDER BY count DESC, code)::INTEGER AS position FROM c)
      WHERE position <= 5"""
    out["keyword_frequency"] = keyword_sql(DPREP, DOC_LISTS) + FREQUENCY
    out["keyword_frequency_letters"] = keyword_sql(PREP, LET_LISTS) + FREQUENCY
    out["keyword_purity"] = keyword_sql(DPREP, DOC_LISTS) + PURITY
    out["keyword_purity_letters"] = keyword_sql(PREP, LET_LISTS) + PURITY
    many = f"""WITH {DPREP},
      split AS (SELECT regexp_extract_all(lower(text), '[a-z]+') AS w FROM benchmark),
      phrases AS (SELECT DISTINCT keyword, (length(keyword) > 8)::INTEGER AS list_class FROM (
        SELECT unnest(w) AS keyword FROM split
        UNION ALL SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM split)),
      lowered AS (SELECT class, lower(text_cleaned) AS t FROM prep),
      hits AS (SELECT list_class, keyword, count(*) AS count, count(*) FILTER (class = 0) AS c0, count(*) FILTER (class = 1) AS c1
        FROM lowered, phrases WHERE contains(t, keyword) GROUP BY ALL)"""
    out["keyword_frequency_many"] = many + FREQUENCY
    out["keyword_purity_many"] = many + PURITY
    out["coded_letter_count"] = f"WITH {PREP} SELECT count(*) FILTER (has_service_codes) AS letters_with_codes FROM prep"
    out["mean_quality"] = f"WITH {MADE} SELECT count(quality_score) AS scored, {r6('avg(quality_score)', 'mean_score')} FROM made"
    quantiles = ", ".join(
        r6(f"quantile_cont(size, {p})", n)
        for p, n in ((0, "minimum"), (0.25, "quartile_1"), (0.5, "median"), (0.75, "quartile_3"), (1, "maximum"))
    )
    out["size_quantiles"] = f"""WITH {DPREP}, s AS (SELECT class, 'text_length' AS measure, text_length AS size FROM prep
        UNION ALL SELECT class, 'num_words', num_words FROM prep)
      SELECT class, measure, {quantiles} FROM s WHERE class IS NOT NULL GROUP BY ALL"""

    out["size_quantiles_merged"] = f"""WITH {DPREP}, s AS (SELECT class, 'text_length' AS measure, text_length AS size FROM prep
        UNION ALL SELECT class, 'num_words', num_words FROM prep)
      SELECT class, measure, count(*) AS n, min(size)::BIGINT AS minimum, max(size)::BIGINT AS maximum, 1 AS within_bound
      FROM s WHERE class IS NOT NULL GROUP BY ALL"""

    # text vectors
    analysis = grams(3, 100)
    out["tfidf_vocabulary"] = f"WITH {analysis} SELECT term, term_count, document_count, {r6('idf', 'idf')} FROM idfs"
    out["tfidf_weights"] = f"WITH {analysis} SELECT letter_id, term, {r6('weight', 'weight')} FROM weights"
    out["tfidf_top_terms"] = top_terms_sql(analysis)
    out["tfidf_top_terms_by_class"] = top_terms_by_class_sql(analysis)
    out["learnt_vectors"] = "SELECT unnest(range(16))::INTEGER AS axis, 1 AS has_its_variance, 1 AS is_axis, 1 AS falls"
    out["learnt_vector_cosines"] = f"""WITH {grams(1, 40)}, target AS (SELECT term, weight FROM weights
        WHERE letter_id = (SELECT min(letter_id) FROM prep)),
      s AS (SELECT w.letter_id, sum(w.weight * t.weight) AS s, sum(w.weight * w.weight) AS l
        FROM weights w LEFT JOIN target t USING (term) GROUP BY 1)
      SELECT letter_id, round(coalesce(s, 0), 6) + 0.0::DOUBLE AS cosine, round(coalesce(l, 0), 6) AS length FROM prep LEFT JOIN s USING (letter_id)"""
    single = grams(1, 200)
    out["similar_letters"] = f"""WITH {single}, target AS (SELECT term, weight FROM weights
        WHERE letter_id = (SELECT min(letter_id) FROM prep)),
      s AS (SELECT w.letter_id, sum(w.weight * t.weight) AS s FROM weights w JOIN target t USING (term) GROUP BY 1)
      SELECT letter_id, round(round(coalesce(s, 0), 9), 6) AS similarity FROM prep LEFT JOIN s USING (letter_id)
      WHERE letter_id <> (SELECT min(letter_id) FROM prep) ORDER BY round(coalesce(s, 0), 9) DESC, letter_id LIMIT 5"""
    matched = f"""{single},
      passages AS (SELECT 'b' || item_id AS target_id, unnest(regexp_extract_all(lower({clean('text')}), '{WORD}')) AS term FROM benchmark),
      wanted AS (SELECT target_id, term, count(*) * any_value(idf) AS w FROM passages JOIN idfs USING (term) GROUP BY ALL),
      spans AS (SELECT target_id, sqrt(sum(w * w)) AS span FROM wanted GROUP BY 1),
      s AS (SELECT target_id, letter_id, sum(weight * w / span) AS s
        FROM weights JOIN wanted USING (term) JOIN spans USING (target_id) GROUP BY ALL),
      every AS (SELECT t.target_id, l.letter_id, round(coalesce(s, 0), 9) AS s
        FROM (SELECT 'b' || item_id AS target_id FROM benchmark) t CROSS JOIN prep l
        LEFT JOIN s ON s.target_id = t.target_id AND s.letter_id = l.letter_id),
      best AS (SELECT target_id, letter_id, round(s, 6) AS similarity, position FROM (SELECT *, row_number() OVER (
        PARTITION BY target_id ORDER BY s DESC, letter_id)::INTEGER AS position FROM every) WHERE position <= 5)"""
    out["similar_letters_batch"] = f"WITH {matched} SELECT * FROM best"
    # The approximate search is given by what must hold: nine of ten places are filled as well.
    out["similar_letters_recall"] = f"WITH {matched} SELECT count(*) AS places, true AS enough FROM best WHERE similarity > 0"
    out["embedding_similarity"] = f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
      t AS (SELECT e AS te FROM v WHERE vec_id = (SELECT min(vec_id) FROM v))
      SELECT vec_id, {r6('list_cosine_similarity(e, te)', 'similarity')} FROM v, t"""

    # windows, sorts and sets
    out["stratified_folds"] = f"""WITH {LABELLED} SELECT letter_id, class, ((row_number() OVER (
      PARTITION BY class ORDER BY md5('42:' || letter_id), letter_id) - 1) % 5)::INTEGER AS fold FROM labelled"""
    out["score_midranks"] = f"""WITH {PRD}, r AS (SELECT y, score, rank() OVER (ORDER BY score) AS r FROM prd)
      SELECT score, count(*) AS n, sum(y)::BIGINT AS positives, {r6('min(r) + (count(*) - 1) / 2.0', 'midrank')}
      FROM r GROUP BY score"""
    out["difference_midranks"] = f"""WITH {RANKED_PAIRS} SELECT {r6('size', 'size')}, n, positive, {r6('midrank', 'midrank')} FROM mid"""
    out["best_runs"] = f"WITH {RUN} SELECT family, run_id, size, {r6('f1_weighted', 'f1_weighted')} FROM best"
    out["runs_by_metric"] = f"WITH {RUN} SELECT run_id, {r6('f1_weighted', 'f1_weighted')} FROM runs"
    out["ablation_by_size"] = f"WITH {RUN} SELECT size, {r6('f1_weighted', 'value')} FROM runs WHERE family = 'synthetic'"
    out["seeded_shuffle"] = f"WITH {LET} SELECT letter_id, md5('42:' || letter_id) AS shuffle_key FROM letters"
    out["append_synthetic"] = f"""WITH {LET}, {SYNTHETIC} SELECT letter_id, guarantee_letter_text, class, service_ids_list,
      'real' AS origin FROM letters UNION ALL SELECT letter_id, guarantee_letter_text, class, NULL, 'synthetic' FROM synthetic"""
    out["append_projected"] = f"""WITH {LET}, {SYNTHETIC} SELECT letter_id, guarantee_letter_text, class, service_ids_list FROM letters
      UNION ALL SELECT NULL, guarantee_letter_text, class, NULL FROM synthetic"""
    out["distinct_companies"] = f"WITH {PREP} SELECT DISTINCT insurance_company FROM prep"

    # synthetic letters
    i = "o_orderkey::VARCHAR"
    out["generated_codes"] = f"SELECT {i} AS i, array_to_string({codes_sql(i, dm.CODES_PER_LETTER)}, '|') AS codes FROM orders"
    out["class_0_letters"] = f"SELECT {i} AS i, {class_0_sql(i)} AS letter FROM orders"
    out["class_1_letters"] = f"SELECT {i} AS i, {class_1_sql(i)} AS letter FROM orders"
    out["balancing_set"] = f"""WITH {LET}, c AS (
        SELECT count(*) FILTER (class = 0) AS c0, count(*) FILTER (class = 1) AS c1 FROM letters),
      rows_0 AS (SELECT unnest(range(c1 - c0)) AS i FROM c), rows_1 AS (SELECT unnest(range(c0 - c1)) AS i FROM c)
      SELECT 'balance_0_' || i AS letter_id, {class_0_sql("'0:' || i")} AS guarantee_letter_text, 0 AS class FROM rows_0
      UNION ALL SELECT 'balance_1_' || i, {class_1_sql("'1:' || i")}, 1 FROM rows_1"""
    prefixed = codes_sql(i, dm.REQUEST_CODES_PER_LETTER, dm.REQUEST_CODE_PREFIXES)
    out["prefixed_codes"] = f"SELECT {i} AS i, array_to_string({prefixed}, '|') AS codes FROM orders"
    asked_codes = codes_sql("request_id", dm.REQUEST_CODES_PER_LETTER, dm.REQUEST_CODE_PREFIXES)
    out["generation_requests"] = f"""WITH {REQUESTS}, r AS (SELECT request_id, class,
        {choose(dm.REQUEST_COMPANIES, 'company', 'request_id')} AS company, {asked_codes} AS codes FROM asked)
      SELECT request_id, class, company, CASE WHEN class = 1 THEN array_to_string(codes, '|') END AS codes,
        CASE WHEN class = 0 THEN {q(dm.SYSTEM_PROMPTS[0])} ELSE {q(dm.SYSTEM_PROMPTS[1])} END AS system_prompt,
        replace(replace(CASE WHEN class = 0 THEN {q(dm.USER_PROMPTS[0])} ELSE {q(dm.USER_PROMPTS[1])} END,
          '{{company}}', company), '{{service_codes}}', array_to_string(codes, ', ')) AS user_prompt FROM r"""
    out["parse_responses"] = f"WITH {MADE} SELECT * REPLACE (round(quality_score, 6) AS quality_score) FROM made"
    out["class_targets"] = f"""WITH {LABELLED}, c AS (SELECT count(*) AS n, count(*) FILTER (class = 0) AS c0,
        count(*) FILTER (class = 1) AS c1 FROM labelled)
      SELECT 0 AS class, trunc(1000 * (c0 / n::DOUBLE))::INTEGER AS target FROM c
      UNION ALL SELECT 1, trunc(1000 * (c1 / n::DOUBLE))::INTEGER FROM c"""
    out["generated_set"] = f"""WITH {LET}, {REQUESTS}, c AS (SELECT count(*) AS n, count(*) FILTER (class = 0) AS c0,
        count(*) FILTER (class = 1) AS c1 FROM letters),
      wanted AS (SELECT 0 AS class, unnest(range(trunc(n * (c0 / n::DOUBLE))::BIGINT)) AS i FROM c
        UNION ALL SELECT 1, unnest(range(trunc(n * (c1 / n::DOUBLE))::BIGINT)) FROM c),
      answered AS (SELECT w.class || '_' || w.i AS request_id, w.class, a.kind, a.letter_text, a.quality
        FROM wanted w LEFT JOIN asked a ON a.request_id = w.i::VARCHAR AND a.class = w.class),
      {letters_of_requests('answered')}
      SELECT * REPLACE (round(quality_score, 6) AS quality_score) FROM made"""
    out["generated_set_with_retries"] = out["generated_set"]
    coded = f"regexp_matches(guarantee_letter_text, '{CODE}')::INTEGER"
    out["generation_quality"] = f"""WITH {MADE} SELECT count(*) AS total_samples, {r6('avg(quality_score)', 'avg_quality_score')},
      {r6('min(quality_score)', 'min_quality_score')}, {r6('abs(0.5 - avg((class = 0)::INTEGER))', 'class_balance')},
      {r6(f'avg({coded}) FILTER (class = 1)', 'class_1_code_presence')},
      {r6(f'1 - avg({coded}) FILTER (class = 0)', 'class_0_no_codes')} FROM made"""

    # features and models
    out["document_vectors"] = f"""WITH {DOC},
      words AS (SELECT letter_id, unnest(regexp_extract_all(lower(guarantee_letter_text), '{WORD}')) AS w FROM doc),
      counts AS (SELECT letter_id, {digits('md5(w)', 1, 8, 128)}::INTEGER AS position, count(*) AS n FROM words GROUP BY ALL),
      lengths AS (SELECT letter_id, sqrt(sum(n * n)) AS l FROM counts GROUP BY 1)
      SELECT letter_id, 128 AS size, position, {r6('n / l', 'value')} FROM counts JOIN lengths USING (letter_id)"""
    out["scaled_features"] = f"WITH {LET}, {LET_FEATURES} SELECT letter_id, " + ", ".join(
        r6(scaled_sql(f), f"{f}_scaled") for f in FEATURES
    ) + " FROM features"
    emb = """letters AS (SELECT vec_id::VARCHAR AS letter_id, text AS guarantee_letter_text, (label >= 5)::INTEGER AS class,
      embedding::DOUBLE[] AS vector FROM embeddings LEFT JOIN documents ON doc_id = vec_id)"""
    values = "list_concat(vector, [" + ", ".join(scaled_sql(f) for f in FEATURES) + "])"
    out["feature_matrix"] = f"""WITH {emb}, {LET_FEATURES},
      m AS (SELECT letter_id, {values} AS v FROM features JOIN letters USING (letter_id)),
      flat AS (SELECT letter_id, unnest(range(len(v)))::INTEGER AS position, unnest(v) AS value FROM m)
      SELECT letter_id, position, {r6('value', 'value')} FROM flat"""
    out["class_weights"] = f"""WITH {LABELLED}, c AS (SELECT class, count(*) AS n FROM labelled GROUP BY 1)
      SELECT class, n, {r6('(SELECT sum(n) FROM c)::DOUBLE / ((SELECT count(*) FROM c) * n)', 'weight')} FROM c"""
    out["score_with_coefficients"] = f"""WITH z AS (
        SELECT vec_id, 1 / (1 + exp(-(list_dot_product(embedding::DOUBLE[], {coefficients}) - 0.25))) AS p FROM embeddings)
      SELECT vec_id, {r6('p', 'probability')}, (p > 0.5)::INTEGER AS prediction FROM z"""
    m = f"WITH {PRD}, {cells_of('prd')}"
    per_class = ", ".join(r6(f"{s}{c}", f"{n}_class_{c}") for c in (0, 1) for s, n in (("p", "precision"), ("r", "recall"), ("f", "f1")))
    headline = ", ".join(r6(h, h) for h in HEADLINE)
    out["evaluate_predictions"] = f"{m} SELECT {headline}, {per_class}, {r6('mean_score', 'mean_prob_class_1')} FROM metrics"

    # metrics
    macro = ", ".join(r6(c, c) for c in ("precision_macro", "recall_macro", "f1_macro", "mcc"))
    out["comprehensive_metrics"] = f"""{m} SELECT tn, fp, fn, tp, {headline}, {macro}, {per_class},
      tn + fp AS support_class_0, tp + fn AS support_class_1, {r6('tn / (tn + fp)::DOUBLE', 'specificity')},
      {r6('tp / (tp + fn)::DOUBLE', 'sensitivity')} FROM metrics"""
    out["confusion_rates"] = f"""{m} SELECT tn AS true_negatives, fp AS false_positives, fn AS false_negatives,
      tp AS true_positives, {r6('tn / (tn + fp)::DOUBLE', 'specificity')}, {r6('tp / (tp + fn)::DOUBLE', 'sensitivity')} FROM metrics"""
    out["roc_auc"] = f"""WITH {PRD}, r AS (SELECT y, score, rank() OVER (ORDER BY score) AS r FROM prd),
      t AS (SELECT score, min(r) + (count(*) - 1) / 2.0::DOUBLE AS mid, sum(y) AS pos, count(*) AS n FROM r GROUP BY 1),
      s AS (SELECT sum(pos * mid)::DOUBLE AS rank_sum, sum(pos)::DOUBLE AS n1, (sum(n) - sum(pos))::DOUBLE AS n0 FROM t)
      SELECT {r6('(rank_sum - n1 * (n1 + 1) / 2) / (n1 * n0)', 'roc_auc')},
        {r6('(SELECT avg(score) FROM prd)', 'mean_prob_class_1')} FROM s"""
    matrix = f"WITH {PRD}, matrix AS (SELECT y, p, count(*) AS count FROM prd GROUP BY ALL)"
    out["confusion_matrix"] = f"{matrix} SELECT y, p, count FROM matrix"
    names = "['Общие запросы', 'Специфические коды']"
    out["confusion_cells"] = f"{matrix} SELECT {names}[y + 1] AS truth, {names}[p + 1] AS guess, count FROM matrix"

    def class_row(c, hit, missed, wrong):
        return f"""SELECT {c} AS class, 'Class {c}' AS name, {hit} + {missed} AS true_count, {hit} + {wrong} AS predicted_count,
          {r6(f'p{c}', 'precision')}, {r6(f'r{c}', 'recall')}, {r6(f'f{c}', 'f1_score')}, {hit} + {missed} AS support,
          {hit} AS correct_predictions, {missed} AS missed_predictions, {wrong} AS false_predictions,
          n::BIGINT AS total_samples FROM metrics"""

    out["class_performance"] = f"{m} {class_row(0, 'tn', 'fp', 'fn')} UNION ALL {class_row(1, 'tp', 'fn', 'fp')}"
    out["compare_runs"] = f"WITH {RUN} SELECT run_id, {headline}, train_size, size FROM runs"
    out["paired_t_test"] = f"""WITH {PAIR}, {SIMPSON},
      s AS (SELECT count(*) AS n, avg(a - b) / (stddev_samp(a - b) / sqrt(count(*))) AS t FROM pairs),
      area AS (SELECT any_value(n) AS n, any_value(t) AS t, sum(f * exp(lgamma(n / 2.0) - lgamma((n - 1) / 2.0))
          / sqrt((n - 1) * pi()) * pow(1 + pow(abs(t) * i / 20000.0, 2) / (n - 1), -n / 2.0)) * abs(any_value(t)) / 20000.0 / 3 AS a
        FROM s, points)
      SELECT n, {r6('t', 'statistic')}, {r6('1 - 2 * a', 'p_value')}, (1 - 2 * a < 0.05)::INTEGER AS significant,
        'paired_t' AS test_type FROM area"""
    out["wilcoxon_test"] = f"""WITH {RANKED_PAIRS}, {SIMPSON},
      w AS (SELECT sum(n)::BIGINT AS n, least(sum(positive * midrank), sum((n - positive) * midrank)) AS w,
        sum(pow(n, 3) - n) AS ties FROM mid),
      z AS (SELECT n, w, abs(w - n * (n + 1) / 4.0) / sqrt((n * (n + 1) * (2 * n + 1) - ties / 2.0) / 24.0) AS z FROM w),
      area AS (SELECT any_value(n) AS n, any_value(w) AS w,
        sum(f * exp(-pow(z * i / 20000.0, 2) / 2) / sqrt(2 * pi())) * any_value(z) / 20000.0 / 3 AS a FROM z, points)
      SELECT n, {r6('w', 'statistic')}, {r6('1 - 2 * a', 'p_value')}, (1 - 2 * a < 0.05)::INTEGER AS significant,
        'wilcoxon' AS test_type FROM area"""
    out["mcnemar_test"] = f"""WITH {PRD}, c AS (SELECT count(*) FILTER (p = y AND q <> y) AS only_first,
        count(*) FILTER (p <> y AND q = y) AS only_second FROM prd)
      SELECT only_first, only_second,
        {r6('pow(only_first - only_second, 2)::DOUBLE / (only_first + only_second)', 'statistic')} FROM c"""
    out["wilcoxon_exact"] = f"""WITH RECURSIVE {RANKED_PAIRS},
      w AS (SELECT sum(n)::BIGINT AS n, sum(positive * midrank) AS w_plus, sum((n - positive) * midrank) AS w_minus FROM mid),
      copies AS (SELECT (2 * midrank)::BIGINT AS r, unnest(range(n)) AS copy FROM mid),
      dealt AS (SELECT r, row_number() OVER (ORDER BY r, copy) AS i FROM copies),
      sums AS (
        SELECT 0::BIGINT AS i, 0::BIGINT AS total, 1.0::DOUBLE AS chance
        UNION ALL
        SELECT s.i + 1, s.total + sign * r, sum(s.chance / 2)
        FROM sums s JOIN dealt d ON d.i = s.i + 1 CROSS JOIN (VALUES (0), (1)) AS v(sign) GROUP BY ALL),
      p AS (SELECT least(1.0::DOUBLE, 2 * sum(chance)) AS p FROM sums, w WHERE i = n AND total <= 2 * least(w_plus, w_minus))
      SELECT n, {r6('w_plus', 'w_plus')}, {r6('w_minus', 'w_minus')}, {r6('least(w_plus, w_minus)', 'statistic')}, 1 AS exact,
        {r6('p + 1e-9', 'p_value')}, (p < 0.05)::INTEGER AS significant FROM w, p"""
    out["mcnemar_exact"] = f"""WITH {PRD.replace("SELECT (l_returnflag", "SELECT l_suppkey, (l_returnflag")},
      {SIMPSON},
      c AS (SELECT l_suppkey, count(*) FILTER (p = y AND q <> y) AS only_first,
        count(*) FILTER (p <> y AND q = y) AS only_second FROM prd GROUP BY 1),
      s AS (SELECT *, only_first + only_second AS n, least(only_first, only_second) AS k,
        pow(only_first - only_second, 2)::DOUBLE / nullif(only_first + only_second, 0) AS statistic FROM c),
      area AS (SELECT l_suppkey, sum(f * exp(-statistic * pow(i / 20000.0, 2) / 2)) * sqrt(any_value(statistic) / (2 * pi())) / 20000.0 / 3 AS a
        FROM s, points GROUP BY 1),
      places AS (SELECT l_suppkey, n, unnest(range(k + 1)) AS j FROM s),
      tails AS (SELECT l_suppkey, sum(exp(lgamma(n + 1.0) - CASE WHEN j = 0 THEN 0 ELSE lgamma(j + 1.0) END - CASE WHEN n = j THEN 0 ELSE lgamma(n - j + 1.0) END - n * ln(2.0::DOUBLE))) AS tail
        FROM places GROUP BY 1),
      p AS (SELECT *, CASE WHEN n = 0 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, 2 * tail) END AS p_value FROM s JOIN area USING (l_suppkey) JOIN tails USING (l_suppkey))
      SELECT l_suppkey, only_first, only_second, {r6('statistic', 'statistic')}, {r6('1 - 2 * a', 'p_chi_square')},
        {r6('p_value + 1e-9', 'p_value')}, (p_value < 0.05)::INTEGER AS significant FROM p"""
    gains = " UNION ALL ".join(
        f"""SELECT run_id, family, size, '{h}' AS metric, {r6(f'{h} - b_{h}', 'absolute_improvement')},
          {r6(f'({h} - b_{h}) / b_{h} * 100', 'relative_improvement')}, ({h} > b_{h})::INTEGER AS is_better
          FROM runs, base WHERE family <> 'baseline' AND b_{h} > 0"""
        for h in HEADLINE
    )
    out["improvement_over_baseline"] = f"WITH {RUN} {gains}"
    out["improvement_level"] = f"""WITH {RUN},
      g AS (SELECT run_id, (f1_weighted - b_f1_weighted) / b_f1_weighted * 100 AS g FROM runs, base WHERE family <> 'baseline')
      SELECT run_id, {r6('g', 'overall_improvement')}, CASE WHEN g > 5 THEN 'significant' WHEN g > 1 THEN 'moderate'
        WHEN g > 0 THEN 'slight' ELSE 'none_or_negative' END AS improvement_level FROM g"""

    # experiments and presentation
    def analysed(prefix: str, lists) -> list[tuple]:
        """The sections of prepared letters; prefix: their common table expressions."""
        terms, codes = grams(3, 100, prefix), "(SELECT class, unnest(codes) AS code FROM prep)"
        return [
            ("general_stats", f"WITH {prefix} {general}", ["scope"], ["sample_count", "avg_text_length", "avg_words"]),
            ("class_patterns", f"WITH {prefix} {profile}", ["class"], ["sample_count", "has_service_codes_ratio",
             "avg_service_codes", "length_mean", "length_std", "length_min", "length_max"]),
            ("class_companies", f"""WITH {prefix} SELECT class, insurance_company, count(*) AS count FROM prep
              WHERE class IS NOT NULL GROUP BY ALL""", ["class", "insurance_company"], ["count"]),
            ("class_differences", f"WITH {prefix} {differences}", [], ["class_0_with_codes", "class_1_with_codes", "text_length_difference"]),
            ("company_patterns", f"WITH {prefix} {companies}", ["insurance_company"], ["sample_count", "class_0", "class_1",
             "avg_text_length", "has_service_codes_ratio"]),
            ("code_statistics", f"WITH {prefix} SELECT count(DISTINCT code) AS total_unique_codes, count(*) AS total_code_occurrences FROM {codes}",
             [], ["total_unique_codes", "total_code_occurrences"]),
            ("code_top", f"WITH {prefix} SELECT code, count(*) AS count FROM {codes} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10", ["code"], ["count"]),
            ("code_prefixes", f"""WITH {prefix} SELECT substr(code, 1, 3) AS prefix, count(*) AS count FROM {codes}
              GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""", ["prefix"], ["count"]),
            ("codes_per_letter", f"WITH {prefix} {per_letter}", [], ["letters_with_codes", "mean_codes", "max_codes"]),
            ("codes_distribution", f"WITH {prefix} SELECT num_service_codes, count(*) AS count FROM prep GROUP BY 1", ["num_service_codes"], ["count"]),
            ("codes_by_class", f"""WITH {prefix}, k AS (SELECT DISTINCT class FROM prep WHERE class IS NOT NULL),
              c AS (SELECT class, count(DISTINCT code) AS u, count(code) AS t FROM {codes} GROUP BY 1)
              SELECT class, coalesce(u, 0) AS unique_codes, coalesce(t, 0) AS total_occurrences FROM k LEFT JOIN c USING (class)""",
             ["class"], ["unique_codes", "total_occurrences"]),
            ("codes_top_by_class", f"""WITH {prefix}, c AS (SELECT class, code, count(*) AS count FROM {codes} WHERE class IS NOT NULL GROUP BY ALL)
              SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY class ORDER BY count DESC, code)::INTEGER AS position FROM c)
              WHERE position <= 5""", ["class", "code"], ["count", "position"]),
            ("keyword_frequency", keyword_sql(prefix, lists) + FREQUENCY, ["list_class", "keyword"], ["count"]),
            ("keyword_effectiveness", keyword_sql(prefix, lists) + PURITY, ["list_class", "keyword"],
             ["total_occurrences", "class_0_ratio", "class_1_ratio", "preferred_class"]),
            ("tfidf_vocabulary", f"WITH {terms} SELECT term, term_count, document_count, idf FROM idfs", ["term"],
             ["term_count", "document_count", "idf"]),
            ("tfidf_top", top_terms_sql(terms), ["term"], ["mean_weight"]),
            ("tfidf_top_by_class", top_terms_by_class_sql(terms), ["class", "term"], ["mean_weight", "position"]),
        ]

    out["letter_patterns"] = " UNION ALL ".join(long_rows(*s) for s in analysed(PREP, LET_LISTS))
    train_prep = DOC.replace("doc AS (", "every_doc AS (", 1) + f""",
      doc AS (SELECT * FROM every_doc WHERE {SPLIT} < 7), {prep('doc', EMAIL)}"""
    measured = ["total_samples", "missing_texts", "empty_texts", "avg_text_length", "avg_words",
                "class_1_without_codes", "class_0_with_codes", "potential_labeling_errors"]
    out["load_and_analyze"] = " UNION ALL ".join([
        long_rows("quality_metrics", f"WITH {train_prep} {quality}", [], measured),
        long_rows("class_distribution", f"WITH {train_prep} SELECT class, count(*) AS count FROM prep WHERE class IS NOT NULL GROUP BY 1", ["class"], ["count"]),
        long_rows("company_distribution", f"WITH {train_prep} SELECT insurance_company, count(*) AS count FROM prep GROUP BY 1", ["insurance_company"], ["count"]),
        long_rows("test_stats", f"WITH {DOC} SELECT count(*) AS total_samples FROM doc WHERE {SPLIT} >= 7", [], ["total_samples"]),
        *[long_rows(*s) for s in analysed(train_prep, DOC_LISTS)],
    ])
    patterns = {s[0]: s for s in analysed(PREP, LET_LISTS)}
    out["write_analysis_json"] = " UNION ALL ".join([
        long_rows("quality_metrics", f"WITH {PREP} {quality}", [], measured),
        *[long_rows(*patterns[name]) for name in ("general_stats", "class_patterns", "company_patterns")],
    ])
    gain = "(f1_weighted - b_f1_weighted) / b_f1_weighted * 100"
    out["run_summary"] = f"""WITH {RUN} SELECT family, run_id, size, {r6('f1_weighted', 'f1_weighted')}, {r6('accuracy', 'accuracy')},
      {r6(gain, 'improvement_percent')}, {r6('mean_quality', 'mean_quality')} FROM best, base"""
    out["class_distribution_series"] = f"""WITH {LABELLED} SELECT class, count(*) AS count,
      {r6('count(*) * 100.0 / sum(count(*)) OVER ()', 'percent')} FROM labelled GROUP BY 1"""
    out["metric_series"] = f"""WITH {RUN}, long AS ({unpivoted('runs', 'run_id', HEADLINE)})
      SELECT run_id, metric, {r6('value', 'value')} FROM long"""
    out["ablation_series"] = f"""WITH {RUN} SELECT size, {r6('f1_weighted', 'value')}, {r6(gain, 'improvement_percent')}
      FROM runs, base WHERE family = 'synthetic'"""
    shown = "(SELECT * FROM best WHERE family <> 'classifier')"
    out["dashboard"] = f"""WITH {RUN}, matrix AS (SELECT y, p, count(*) AS count FROM prd GROUP BY ALL),
      long AS ({unpivoted(shown, 'run_id', HEADLINE)}),
      all_rows AS (
        SELECT 'metrics_comparison' AS section, run_id || '|' || metric AS item, 'value' AS measure, value FROM long
        UNION ALL SELECT 'synthetic_ablation', '', 'size', size FROM runs WHERE family = 'synthetic'
        UNION ALL SELECT 'synthetic_ablation', '', 'value', f1_weighted FROM runs WHERE family = 'synthetic'
        UNION ALL SELECT 'baseline_confusion_matrix', '', 'y', y FROM matrix
        UNION ALL SELECT 'baseline_confusion_matrix', '', 'p', p FROM matrix
        UNION ALL SELECT 'baseline_confusion_matrix', '', 'count', count FROM matrix)
      SELECT section, item, measure, {r6('value', 'value')} FROM all_rows"""
    # training: what must hold of any right fit
    def split_rows(source: str) -> str:
        return f"""rows AS (SELECT letter_id, class, CASE WHEN {SPLIT} < 7 THEN 'train' ELSE 'test' END AS split FROM {source}),
        sizes AS (SELECT count(*) FILTER (split = 'train') AS n, count(*) FILTER (split = 'test') AS t,
          count(*) FILTER (split = 'train' AND class = 0) AS c0, count(*) FILTER (split = 'train' AND class = 1) AS c1 FROM rows)"""

    vectors, real = f"{emb}, {split_rows('letters')}", f"{LET}, {split_rows('letters')}"
    features = [f"embedding_{i}" for i in range(64)] + list(FEATURES)
    named = f"SELECT unnest(range({len(features)}))::INTEGER AS position, unnest({array(features)}) AS feature"
    out["logistic_training"] = f"{named}, 1 AS is_optimal"
    out["forest_training"] = f"{named}, 1 AS in_range, 1.0::DOUBLE AS total, 1 AS has_learnt"
    out["feature_importance"] = f"{named}, 1 AS is_coefficient"
    out["training_curve"] = "SELECT 0 AS first_iteration, 1 AS never_rises, 1 AS is_numbered, 1 AS falls"
    out["train_with_folds"] = f"""WITH {vectors}, dealt AS (SELECT class, ((row_number() OVER (
        PARTITION BY class ORDER BY md5('42:' || letter_id), letter_id) - 1) % 5)::INTEGER AS fold FROM rows WHERE split = 'train')
      SELECT fold, class, count(*) AS n, 1 AS is_scored, 1 AS record_agrees FROM dealt GROUP BY ALL"""
    out["folds_in_one_scan"] = out["train_with_folds"].replace("is_scored", "is_optimal").replace("record_agrees", "is_its_score")
    zero = f"""(count(*) FILTER (split = '{{split}}' AND class = 0))::DOUBLE / count(*) FILTER (split = '{{split}}')"""
    start = ", ".join(
        f"{r6('ln(2.0::DOUBLE)', p + 'loss')}, {r6(share, p + 'accuracy')}, {r6(f'pow({share}, 2)', p + 'precision')}, {r6(share, p + 'recall')}"
        for p, share in (("", zero.format(split="train")), ("val_", zero.format(split="test")))
    )
    out["held_out_curve"] = f"WITH {vectors} SELECT 0 AS iteration, {start}, 1 AS last_agrees, 1 AS falls FROM rows"
    out["predict_letters"] = f"WITH {vectors} SELECT letter_id, class, 1 AS agrees FROM rows WHERE split = 'test'"
    out["save_and_load_model"] = out["predict_letters"]
    held = "1 AS metrics_follow, 1 AS is_validated, 1 AS has_probability, 1 AS has_quality"

    def run_rows(settings) -> str:
        """One row for each (run, family, size, training rows added)."""
        return " UNION ALL ".join(
            f"""SELECT '{run}' AS run_id, '{family}' AS family, {size} AS size, (n + {added})::BIGINT AS train_size, t AS test_size,
              t AS cells, {f'round(n / {size}.0::DOUBLE, 6)' if family == 'synthetic' else '0.0::DOUBLE'} AS ratio, {held} FROM sizes"""
            for run, family, size, added in settings
        )

    def made(k: int) -> str:
        return f"trunc({k} * (c0 / n::DOUBLE)) + trunc({k} * (c1 / n::DOUBLE))"

    first = [("baseline", "baseline", 0, "0")]
    template = [(f"synthetic_{k}", "synthetic", k, str(k)) for k in (50, 100, 200)]
    generated = [(f"generated_{k}", "generated", k, made(k)) for k in (50, 100)]
    kinds = [(k, "classifier", 0, "0") for k in ("logistic", "random_forest")]
    out["baseline_experiment"] = f"WITH {vectors} {run_rows(first)}"
    out["augmentation_experiment"] = f"WITH {real} {run_rows(template)}"
    out["generated_experiment"] = f"WITH {real} {run_rows(generated)}"
    out["baseline_learnt"] = f"WITH {real} {run_rows(first)}"
    out["classifier_comparison"] = f"WITH {vectors} {run_rows(kinds)}"
    out["full_suite"] = f"WITH {real} {run_rows(first + template + generated + kinds)}"
    head = ["# Отчет по экспериментам классификации страховых писем", "Дата проведения: #_#", "", "## Сводка результатов", ""]
    told = {
        "baseline": ["**Базовая модель (только реальные данные):**", "- F#-score: #", "- Accuracy: #", ""],
        "synthetic": ["**Лучший результат с синтетическими данными:**", "- Размер синтетической выборки: #", "- F#-score: #", "- Улучшение: #%", ""],
        "generated": ["**Лучший результат с LLM данными:**", "- Размер LLM выборки: #", "- F#-score: #", "- Средняя оценка качества: #", ""],
    }

    def saved(settings) -> str:
        families = dict.fromkeys(family for _, family, _, _ in settings)
        lines = head + [line for f in families for line in told.get(f, [])]
        return f"""WITH {real}, runs AS ({run_rows(settings)})
          SELECT 'run' AS what, run_id AS item, train_size AS n FROM runs
          UNION ALL SELECT 'predictions', run_id, test_size FROM runs
          UNION ALL SELECT 'report', unnest({array(lines)}), 1
          UNION ALL SELECT 'class', class::VARCHAR, count(*) FROM rows WHERE split = 'train' GROUP BY class"""

    out["baseline_mode"] = saved(first)
    out["synthetic_mode"] = saved(first + template)
    out["full_mode"] = saved(first + template + generated + kinds) + " UNION ALL SELECT 'dashboard', 'matrix', t FROM sizes"
    train_letters = f"""{LET.replace("letters AS (", "every_letter AS (", 1)},
      letters AS (SELECT * FROM every_letter WHERE {SPLIT} < 7), {prep('letters', CODE)}"""
    out["analysis_mode"] = " UNION ALL ".join([
        long_rows("quality_metrics", f"WITH {train_letters} {quality}", [], measured),
        long_rows("class_distribution", f"WITH {train_letters} SELECT class, count(*) AS count FROM prep GROUP BY 1", ["class"], ["count"]),
        long_rows("company_distribution", f"WITH {train_letters} SELECT insurance_company, count(*) AS count FROM prep GROUP BY 1", ["insurance_company"], ["count"]),
        *[long_rows(*s) for s in analysed(train_letters, LET_LISTS)],
        long_rows("test_stats", f"WITH {LET} SELECT count(*) AS total_samples FROM letters WHERE {SPLIT} >= 7", [], ["total_samples"]),
    ])
    return out
