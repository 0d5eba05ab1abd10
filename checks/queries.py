"""One query per operator over the given tables.

Doubles are rounded to six decimals and arrays are joined to text, so that
results compare by value with those of another engine.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from checks.oracle import ID_FORMS
from lettermill.domain import DEFAULT
from lettermill.functions import text as tx
from lettermill.functions import vectors as vx
from lettermill.functions.ids import parse_service_ids
from lettermill.operators import classifier as clf
from lettermill.operators import features as ft
from lettermill.operators import metrics as mt
from lettermill.operators import phrases as ph
from lettermill.operators import profile as pf
from lettermill.operators import quantiles as qt
from lettermill.operators import ranking as rk
from lettermill.operators import requests as rq
from lettermill.operators import runs as rn
from lettermill.operators import significance as sg
from lettermill.operators import similar as sm
from lettermill.operators import synth as sy
from lettermill.operators import termspace as ts
from lettermill.operators import tfidf as ti
from lettermill.operators.catalogue import resolve_services, service_mapping
from lettermill.operators.preprocess import FEATURE_NAMES, handcrafted_features, preprocess_letters
from lettermill.operators.storage import stored
from lettermill.plans import analysis, experiments
from lettermill.plans import inputs as inp
from lettermill.sources import letters as src
from lettermill.sources import results as sink
from lettermill.sources import runstore as store

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
DOC = inp.DOCUMENTS
# Coefficients of the scoring query: any fixed numbers will do.
COEFFICIENTS = tuple(round(((i * 37) % 17 - 8) / 8, 4) for i in range(64))


def raw() -> Column:
    return F.col("guarantee_letter_text")


def clean() -> Column:
    return F.col("text_cleaned")


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(
        *[F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    )


def joined(array: Column) -> Column:
    return F.array_join(array, "|")


def joined_numbers(array: Column) -> Column:
    return F.array_join(F.transform(array, lambda x: x.cast("string")), "|")


def letters(spark: SparkSession, sf: str) -> DataFrame:
    return inp.letters(spark, sf)


def prepared(spark: SparkSession, sf: str) -> DataFrame:
    return preprocess_letters(inp.letters(spark, sf))


def prepared_documents(spark: SparkSession, sf: str) -> DataFrame:
    return preprocess_letters(inp.documents(spark, sf), DOC)


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return inp.documents(spark, sf)


# --- sources and sinks -----------------------------------------------------------


def _class() -> Column:
    """The class as text, as it may be null."""
    return F.col("class").cast("string").alias("class")


@query
def read_training_letters(spark, sf):
    return documents(spark, sf).where(inp.split_of(F.col("letter_id")) == "train").select("letter_id", raw(), _class())


@query
def read_test_letters(spark, sf):
    return documents(spark, sf).where(inp.split_of(F.col("letter_id")) == "test").select("letter_id", raw(), _class())


@query
def read_service_catalogue(spark, sf):
    return inp.services(spark, sf)


def _synthetic(spark, sf):
    base = letters(spark, sf)
    counts = sy.class_counts(base)
    return sy.ratio_preserving_set(base, 2 * counts[0], counts=counts)


def _edges(spark, sf):
    """A letter per order whose text has blanks, quotes and line ends at its edges, or is empty or missing."""
    key = F.col("o_orderkey")
    forms = ["  lead {k}", "trail {k} \n", 'say "{k}", then, end', "two\r\nlines {k}", "\\{k}\\", "", None]
    text = F.element_at(F.array(*[F.lit(f) for f in forms]), (key % len(forms) + 1).cast("int"))
    text = F.replace(text, F.lit("{k}"), key.cast("string"))
    rows = inp.table(spark, sf, "orders")
    return rows.select(F.concat(F.lit("edge_"), key.cast("string")).alias("letter_id"), text.alias("guarantee_letter_text"), F.lit(0).alias("class"))


@query
def write_letters_csv(spark, sf):
    path = sink.work_folder(spark)
    sink.write_letters_csv(_synthetic(spark, sf).unionByName(_edges(spark, sf)), path)
    return sink.read_letters_csv(spark, path, sy.SCHEMA)


@query
def load_three_tables(spark, sf):
    """Both splits and the catalogue, written as a table of each kind and loaded from there."""
    out = []
    catalogue = inp.services(spark, sf)
    train, test = _document_splits(spark, sf)
    for kind in ("parquet", "json", "csv"):
        path = sink.work_folder(spark)
        for name, rows in (("train", train), ("test", test), ("services", catalogue)):
            if kind == "csv":
                sink.write_letters_csv(rows, f"{path}/{name}")
            else:
                rows.write.format(kind).save(f"{path}/{name}")
        loaded = src.load_data(spark, f"{path}/train", f"{path}/test", f"{path}/services", kind)
        for name, rows in zip(("train", "test"), loaded[:2]):
            digest = F.md5(F.coalesce("guarantee_letter_text", F.lit("none")))
            out.append(rows.select(F.lit(kind).alias("kind"), F.lit(name).alias("part"), F.col("letter_id").alias("id"), _class(), digest.alias("text")))
        services = loaded[2].select(F.lit(kind).alias("kind"), F.lit("services").alias("part"), F.col("service_id").cast("string").alias("id"), F.lit(None).cast("string").alias("class"), F.md5(F.concat("ServiceCode", "ServiceName")).alias("text"))
        out.append(services)
    return pf.union_all(out)


@query
def write_analysis_json(spark, sf):
    path = sink.work_folder(spark)
    # Four sections read these letters, none of them the columns left out.
    rows = prepared(spark, sf).drop("text_cleaned", "service_codes_list", "service_ids_list", "parsed_service_ids")
    rows.persist(StorageLevel.DISK_ONLY)
    sections = {
        "quality_metrics": pf.data_quality(rows),
        "general_stats": pf.general_statistics(rows),
        "class_patterns": pf.class_profile(rows),
        "company_patterns": pf.company_profile(rows),
    }
    sink.write_analysis(sections, path)
    rows.unpersist()
    saved = {name: spark.read.schema(df.schema).json(f"{path}/{name}") for name, df in sections.items()}
    return rounded(analysis.as_long(saved))


@query
def write_results_table(spark, sf):
    path = sink.work_folder(spark)
    sink.write_results_table(rounded(rn.results_table(inp.runs(spark, sf))), path)
    schema = "experiment string, train_size bigint, synthetic_size int, accuracy double, f1 double, precision double, recall double"
    return spark.read.schema(schema).option("header", "true").csv(path)


@query
def write_summary_report(spark, sf):
    path = sink.work_folder(spark)
    sink.write_report(rn.summary_lines(inp.runs(spark, sf), "20240101_000000"), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


RUN_COLUMNS = "run_id string, family string, size int, f1_weighted double"


@query
def latest_run(spark, sf):
    path = sink.work_folder(spark)
    runs = inp.runs(spark, sf).select("run_id", "family", "size", "f1_weighted")
    sink.write_runs(runs.where(F.col("family") == "baseline"), path, "20240101_000000")
    sink.write_runs(runs, path, "20240102_000000")
    return rounded(sink.latest_runs(spark, path, RUN_COLUMNS))


@query
def latest_committed_run(spark, sf):
    """Two committed suites and a later one that was written, but not committed."""
    path = sink.work_folder(spark)
    runs = inp.runs(spark, sf).select("run_id", "family", "size", "f1_weighted")
    store.commit_runs(runs.where(F.col("family") == "baseline"), path, "20240102_000000")
    store.commit_runs(runs, path, "20240101_000000")
    store.write_pending(runs.limit(1), path)
    return rounded(store.committed_runs(spark, path, RUN_COLUMNS))


# --- row-wise text functions -----------------------------------------------------


@query
def clean_text(spark, sf):
    return inp.texts(spark, sf).select("letter_id", tx.clean_text(raw()).alias("text_cleaned"))


@query
def code_presence(spark, sf):
    return letters(spark, sf).select("letter_id", tx.has_codes(tx.clean_text(raw())).cast("int").alias("has_service_codes"))


@query
def code_presence_documents(spark, sf):
    return inp.texts(spark, sf).select(
        "letter_id", tx.has_codes(tx.clean_text(raw()), DOC).cast("int").alias("has_service_codes")
    )


@query
def extract_codes(spark, sf):
    return letters(spark, sf).select("letter_id", joined(tx.extract_codes(tx.clean_text(raw()))).alias("codes"))


@query
def count_codes(spark, sf):
    return letters(spark, sf).select("letter_id", tx.count_codes(tx.clean_text(raw())).alias("num_service_codes"))


@query
def insurance_company(spark, sf):
    return letters(spark, sf).select("letter_id", tx.company(tx.clean_text(raw())).alias("insurance_company"))


@query
def text_length(spark, sf):
    return inp.texts(spark, sf).select("letter_id", tx.text_length(tx.clean_text(raw())).alias("text_length"))


@query
def word_count(spark, sf):
    cleaned = inp.texts(spark, sf).select("letter_id", tx.clean_text(raw()).alias("text_cleaned"))
    return cleaned.select("letter_id", tx.word_count(clean()).alias("num_words"))


@query
def parse_id_lists(spark, sf):
    parsed = parse_service_ids(F.col("service_ids_list"))
    return letters(spark, sf).select("letter_id", joined_numbers(parsed).alias("service_ids"))


@query
def parse_id_forms(spark, sf):
    """Literals of many forms, one for each order."""
    key = F.col("o_orderkey")
    form = F.element_at(F.array(*[F.lit(f) for f in ID_FORMS]), (key % len(ID_FORMS) + 1).cast("int"))
    rows = inp.table(spark, sf, "orders").select(key, F.replace(form, F.lit("{k}"), key.cast("string")).alias("raw"))
    return rows.select("o_orderkey", "raw", joined_numbers(parse_service_ids(F.col("raw"))).alias("ids"))


@query
def code_prefix(spark, sf):
    codes = pf.exploded_codes(prepared(spark, sf))
    return codes.select(F.col("code"), tx.code_prefix(F.col("code")).alias("prefix")).distinct()


@query
def diagnosis_codes(spark, sf):
    return letters(spark, sf).select("letter_id", joined(tx.extract_diagnoses(raw())).alias("diagnoses"))


def _flat(df: DataFrame) -> DataFrame:
    out = {"service_codes_list": joined("service_codes_list"), "has_service_codes": F.col("has_service_codes").cast("int")}
    if "parsed_service_ids" in df.columns:
        out["parsed_service_ids"] = joined_numbers(F.col("parsed_service_ids"))
    return df.withColumns(out)


@query
def preprocess(spark, sf):
    return _flat(prepared(spark, sf))


@query
def preprocess_documents(spark, sf):
    return _flat(prepared_documents(spark, sf)).withColumn("class", _class())


@query
def handcrafted(spark, sf):
    return handcrafted_features(letters(spark, sf)).select("letter_id", *FEATURE_NAMES)


@query
def handcrafted_documents(spark, sf):
    domain = DOC.with_(feature_companies=("src", "the"), feature_class_0=("the", "of"), feature_class_1=("und", "le"))
    return handcrafted_features(documents(spark, sf), domain).select("letter_id", *FEATURE_NAMES)


@query
def model_text(spark, sf):
    return inp.texts(spark, sf).select("letter_id", tx.model_text(raw()).alias("model_text"))


@query
def keyword_substring(spark, sf):
    return inp.texts(spark, sf).select("letter_id", tx.contains_lower(raw(), "und").cast("int").alias("found"))


@query
def phrase_contains(spark, sf):
    folded = inp.texts(spark, sf).select("letter_id", tx.fold_case(tx.clean_text(raw())).alias("folded"))
    return folded.select("letter_id", tx.contains_phrase(F.col("folded"), "And The").cast("int").alias("found"))


@query
def metric_format(spark, sf):
    return inp.runs(spark, sf).select("run_id", tx.fixed_3(F.col("f1_weighted")).alias("f1_text"))


@query
def run_label(spark, sf):
    newest = inp.table(spark, sf, "orders").agg(F.max("o_orderdate").alias("moment"))
    return newest.select(tx.run_label(F.col("moment")).alias("run_label"))


# --- filters -----------------------------------------------------------------------


@query
def rows_of_class(spark, sf):
    return pf.rows_of_class(documents(spark, sf), 0).select("letter_id", "class")


@query
def rows_of_company(spark, sf):
    return pf.rows_of_company(prepared(spark, sf), "Согаз").select("letter_id", "insurance_company")


@query
def letters_with_codes(spark, sf):
    return pf.letters_with_codes(prepared(spark, sf)).select("letter_id", "num_service_codes")


@query
def missing_or_empty_text(spark, sf):
    # The id list is the letters' nullable column.
    rows = letters(spark, sf).select("letter_id", F.regexp_replace("service_ids_list", r"\[\]", "").alias("guarantee_letter_text"))
    return pf.missing_or_empty(rows).select("letter_id", "problem")


@query
def label_contradictions(spark, sf):
    return pf.label_contradictions(prepared(spark, sf)).select("letter_id", "class", "problem")


# --- joins -------------------------------------------------------------------------


@query
def service_map(spark, sf):
    # Part sizes repeat, so the part key decides which entry is the last.
    part = inp.table(spark, sf, "part")
    catalogue = part.select(
        F.col("p_size").alias("service_id"),
        F.col("p_brand").alias("ServiceCode"),
        F.col("p_name").alias("ServiceName"),
        "p_partkey",
    )
    return service_mapping(catalogue, F.col("p_partkey"))


@query
def resolve_service_ids(spark, sf):
    rows = letters(spark, sf).select("letter_id", parse_service_ids(F.col("service_ids_list")).alias("parsed_service_ids"))
    mapping = service_mapping(inp.services(spark, sf), F.col("service_id"))
    resolved = resolve_services(rows, mapping)
    names = F.transform("services", lambda s: F.concat_ws(":", s.service_id.cast("string"), s.code, s["name"]))
    return resolved.select("letter_id", joined(names).alias("services"))


# --- aggregations --------------------------------------------------------------------


@query
def class_value_counts(spark, sf):
    return pf.value_counts(inp.labelled(spark, sf), "class")


@query
def company_value_counts(spark, sf):
    return pf.value_counts(prepared(spark, sf), "insurance_company")


@query
def code_count_value_counts(spark, sf):
    return pf.value_counts(prepared(spark, sf), "num_service_codes")


@query
def class_shares(spark, sf):
    return rounded(pf.class_shares(inp.labelled(spark, sf)))


@query
def data_quality(spark, sf):
    return rounded(pf.data_quality(prepared(spark, sf)))


@query
def data_quality_documents(spark, sf):
    return rounded(pf.data_quality(prepared_documents(spark, sf)))


@query
def general_statistics(spark, sf):
    return rounded(pf.general_statistics(prepared_documents(spark, sf)))


@query
def class_profile(spark, sf):
    return rounded(pf.class_profile(prepared_documents(spark, sf)))


@query
def class_profile_letters(spark, sf):
    return rounded(pf.class_profile(prepared(spark, sf)))


@query
def class_company_counts(spark, sf):
    return pf.class_company_counts(prepared(spark, sf))


@query
def class_differences(spark, sf):
    return rounded(pf.class_differences(prepared(spark, sf)))


@query
def company_profile(spark, sf):
    return rounded(pf.company_profile(prepared(spark, sf)))


@query
def code_statistics(spark, sf):
    return pf.code_statistics(prepared(spark, sf))


@query
def top_codes(spark, sf):
    return pf.top_codes(prepared(spark, sf))


@query
def top_prefixes(spark, sf):
    return pf.top_prefixes(prepared(spark, sf))


@query
def codes_per_letter(spark, sf):
    return rounded(pf.codes_per_letter(prepared(spark, sf)))


@query
def codes_by_class(spark, sf):
    return pf.codes_by_class(prepared(spark, sf))


@query
def top_codes_by_class(spark, sf):
    return pf.top_codes_by_class(prepared(spark, sf))


@query
def keyword_frequency(spark, sf):
    return pf.keyword_frequency(pf.keyword_counts(prepared_documents(spark, sf), DOC))


@query
def keyword_frequency_letters(spark, sf):
    return pf.keyword_frequency(pf.keyword_counts(prepared(spark, sf)))


@query
def keyword_purity(spark, sf):
    return rounded(pf.keyword_purity(pf.keyword_counts(prepared_documents(spark, sf), DOC)))


@query
def keyword_purity_letters(spark, sf):
    return rounded(pf.keyword_purity(pf.keyword_counts(prepared(spark, sf))))


def _many_phrases(spark, sf):
    """Every word of the benchmark passages, and every two words side by side; the longer ones stand for class 1."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    split = inp.table(spark, sf, "benchmark").select(words.alias("w"))
    pairs = F.zip_with(F.slice("w", F.lit(1), F.greatest(F.size("w") - 1, F.lit(0))), F.slice("w", F.lit(2), F.size("w")), lambda a, b: F.concat_ws(" ", a, b))
    found = split.select(F.explode(F.concat("w", pairs)).alias("keyword")).distinct()
    return found.withColumn("list_class", (F.char_length("keyword") > 8).cast("int"))


@query
def keyword_frequency_many(spark, sf):
    return pf.keyword_frequency(ph.keyword_counts(prepared_documents(spark, sf), _many_phrases(spark, sf)))


@query
def keyword_purity_many(spark, sf):
    return rounded(pf.keyword_purity(ph.keyword_counts(prepared_documents(spark, sf), _many_phrases(spark, sf))))


@query
def coded_letter_count(spark, sf):
    return prepared(spark, sf).agg(F.count_if("has_service_codes").alias("letters_with_codes"))


@query
def mean_quality(spark, sf):
    answered = rq.add_requests(inp.responses(spark, sf))
    return rounded(pf.mean_score(rq.parse_responses(answered)))


@query
def size_quantiles(spark, sf):
    return rounded(pf.size_quantiles(prepared_documents(spark, sf)))


@query
def size_quantiles_merged(spark, sf):
    """Sketches saved by split, merged, and their quartiles placed among all letters."""
    rows = prepared_documents(spark, sf).withColumn("split", inp.split_of(F.col("letter_id")))
    path = sink.work_folder(spark)
    qt.size_sketches(rows, "split").write.parquet(path)
    found = qt.five_numbers(qt.merged(spark.read.parquet(path)))
    sizes = rows.select("class", F.inline(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).alias("size")) for c in ("text_length", "num_words")])))
    # Two rows for each class are broadcast by the planner's own size check.
    placed = sizes.join(found, ["class", "measure"])
    inside = F.lit(True)
    for name in ("quartile_1", "median", "quartile_3"):
        below, upto = F.avg((F.col("size") < F.col(name)).cast("int")), F.avg((F.col("size") <= F.col(name)).cast("int"))
        inside &= (below - qt.rank_error() <= qt.SHARES[name]) & (qt.SHARES[name] <= upto + qt.rank_error())
    return placed.groupBy("class", "measure", "n", "minimum", "maximum").agg(_is(inside, "within_bound"))


@query
def letter_patterns(spark, sf):
    rows, _ = stored(prepared(spark, sf))
    kept = _kept(rounded(analysis.as_long(analysis.letter_patterns(rows))))
    rows.unpersist()
    return kept


# --- text vectors ----------------------------------------------------------------------


@query
def tfidf_vocabulary(spark, sf):
    rows = prepared_documents(spark, sf)
    return rounded(ti.vocabulary(rows, ti.fit_tfidf(rows)))


@query
def tfidf_weights(spark, sf):
    rows = prepared_documents(spark, sf)
    return rounded(ti.weights(rows, ti.fit_tfidf(rows)))


@query
def tfidf_top_terms(spark, sf):
    rows = prepared_documents(spark, sf)
    return rounded(ti.top_terms(rows, ti.fit_tfidf(rows)))


@query
def tfidf_top_terms_by_class(spark, sf):
    rows = prepared_documents(spark, sf)
    return rounded(ti.top_terms_by_class(rows, ti.fit_tfidf(rows)))


def _similarity_model(rows):
    return ti.fit_tfidf(rows, max_features=200, ngram_range=(1, 1))


@query
def similar_letters(spark, sf):
    rows = prepared_documents(spark, sf)
    target = inp.documents(spark, sf).agg(F.min("letter_id")).first()[0]
    return rounded(ti.similar_letters(rows, _similarity_model(rows), target))


def _passages(spark, sf):
    """Every benchmark passage, as a target."""
    key = F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("letter_id")
    return inp.table(spark, sf, "benchmark").select(key, tx.clean_text(F.col("text")).alias("text_cleaned"))


@query
def similar_letters_batch(spark, sf):
    rows = prepared_documents(spark, sf)
    return rounded(ti.similar_letters_batch(rows, _passages(spark, sf), _similarity_model(rows)))


@query
def similar_letters_approximate(spark, sf):
    """Letters of an approximate search, all with their exact similarity."""
    rows = prepared_documents(spark, sf)
    return rounded(sm.similar_letters_approximate(rows, _passages(spark, sf), _similarity_model(rows)))


@query
def similar_letters_recall(spark, sf):
    """The approximate search beside the exact one."""
    rows, passages = prepared_documents(spark, sf), _passages(spark, sf)
    model = _similarity_model(rows)
    found = sm.recall(sm.similar_letters_approximate(rows, passages, model), ti.similar_letters_batch(rows, passages, model))
    return found.select("places", (F.col("recall") >= 0.9).alias("enough"))


@query
def embedding_similarity(spark, sf):
    vectors = inp.table(spark, sf, "embeddings")
    target = vectors.agg(F.min("vec_id")).first()[0]
    return rounded(ti.embedding_similarity(vectors, target))


# --- windows, sorts and sets ---------------------------------------------------------


@query
def stratified_folds(spark, sf):
    return rk.stratified_folds(inp.labelled(spark, sf).select("letter_id", "class"))


@query
def score_midranks(spark, sf):
    numeric = inp.predictions(spark, sf).select("y", "score")
    ranked = rk.midranks(numeric, "score", {"positives": F.sum(F.col("y").cast("bigint"))})
    return rounded(ranked.select("score", "n", "positives", "midrank"))


@query
def difference_midranks(spark, sf):
    return rounded(sg.difference_midranks(inp.pairs(spark, sf)).select("size", "n", "positive", "midrank"))


@query
def best_runs(spark, sf):
    return rounded(rn.best_runs(inp.runs(spark, sf)).select("family", "run_id", "size", "f1_weighted"))


@query
def runs_by_metric(spark, sf):
    return rounded(rn.sorted_by_metric(inp.runs(spark, sf)).select("run_id", "f1_weighted"))


@query
def ablation_by_size(spark, sf):
    return rounded(rn.ablation_series(inp.runs(spark, sf)).select("size", "value"))


@query
def code_counts_by_value(spark, sf):
    return pf.counts_by_value(prepared(spark, sf), "num_service_codes")


@query
def seeded_shuffle(spark, sf):
    shuffled = sy.seeded_shuffle(letters(spark, sf).select("letter_id"))
    return shuffled.withColumn("shuffle_key", sy.shuffle_key(42, F.col("letter_id")))


@query
def append_synthetic(spark, sf):
    both = sy.append_synthetic(letters(spark, sf), _synthetic(spark, sf))
    return both.select("letter_id", "guarantee_letter_text", "class", "service_ids_list", "origin")


@query
def append_projected(spark, sf):
    both = sy.append_projected(letters(spark, sf), _synthetic(spark, sf))
    return both.select("letter_id", "guarantee_letter_text", "class", "service_ids_list")


@query
def distinct_companies(spark, sf):
    return pf.distinct_values(prepared(spark, sf), "insurance_company")


# --- synthetic letters ------------------------------------------------------------------


def _orders(spark, sf):
    orders = inp.table(spark, sf, "orders")
    return orders.select(F.col("o_orderkey").cast("string").alias("i"))


@query
def generated_codes(spark, sf):
    return _orders(spark, sf).select("i", joined(sy.service_codes(F.col("i"))).alias("codes"))


@query
def class_0_letters(spark, sf):
    return _orders(spark, sf).select("i", sy.class_0_letter(F.col("i")).alias("letter"))


@query
def class_1_letters(spark, sf):
    return _orders(spark, sf).select("i", sy.class_1_letter(F.col("i")).alias("letter"))


@query
def ratio_preserving_set(spark, sf):
    return _synthetic(spark, sf)


@query
def balancing_set(spark, sf):
    return sy.balancing_set(letters(spark, sf))


@query
def prefixed_codes(spark, sf):
    codes = sy.service_codes(
        F.col("i"), prefixes=DEFAULT.request_code_prefixes, most=DEFAULT.request_codes_per_letter
    )
    return _orders(spark, sf).select("i", joined(codes).alias("codes"))


@query
def generation_requests(spark, sf):
    requests = rq.add_requests(inp.responses(spark, sf))
    return requests.select(
        "request_id", "class", "company", joined("service_codes").alias("codes"), "system_prompt", "user_prompt"
    )


@query
def parse_responses(spark, sf):
    return rounded(rq.parse_responses(rq.add_requests(inp.responses(spark, sf))))


@query
def class_targets(spark, sf):
    sizes = sy.split_size(1000, sy.class_counts(inp.labelled(spark, sf)), "truncate")
    return spark.createDataFrame(list(sizes.items()), "class int, target int")


def _answers(spark, sf):
    rows = inp.responses(spark, sf)
    return rows.select(F.concat(F.col("class").cast("string"), F.lit("_"), F.col("request_id")).alias("request_id"), "response")


@query
def generated_set(spark, sf):
    base = letters(spark, sf)
    counts = sy.class_counts(base)
    requests = rq.generation_requests(spark, sy.split_size(counts[0], counts, "truncate"))
    return rounded(rq.generated_set(requests, _answers(spark, sf)))


@query
def generated_set_with_retries(spark, sf):
    """The same letters from a ledger of broken early answers, retries, repeats and broken late ones."""
    base = letters(spark, sf)
    counts = sy.class_counts(base)
    requests = rq.generation_requests(spark, sy.split_size(counts[0], counts, "truncate"))
    answers = _answers(spark, sf).withColumn("received", F.lit(5))
    broken = answers.withColumn("response", F.lit('{"letter_text": "cut'))
    third = F.pmod(F.xxhash64("request_id"), F.lit(3))
    early, late = broken.where(third < 2).withColumn("received", F.lit(1)), broken.where(third > 0).withColumn("received", F.lit(9))
    ledger = rq.merge_responses(early, answers.where(third == 0))
    ledger = rq.merge_responses(late, rq.merge_responses(ledger, answers), answers)
    return rounded(rq.generated_set(requests, ledger))


@query
def generation_quality(spark, sf):
    return rounded(rq.generation_quality(rq.parse_responses(rq.add_requests(inp.responses(spark, sf)))))


# --- features and models -----------------------------------------------------------------


def _vector_features(spark, sf):
    return ft.raw_features(inp.embeddings(spark, sf), "vector")


def _splits(spark, sf):
    rows = _vector_features(spark, sf)
    return rows.where(F.col("split") == "train"), rows.where(F.col("split") == "test")


def _kept(rows: DataFrame) -> DataFrame:
    """Small rows computed now, so that what they are made from can be released."""
    return rows.sparkSession.createDataFrame(rows.collect(), rows.schema)


def _is(condition: Column, name: str) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("int").alias(name)


@query
def document_vectors(spark, sf):
    # The class has no part in a vector, and a document that is labelled twice has one vector.
    rows = ft.add_vectors(inp.texts(spark, sf))
    # A plain posexplode adds a filter on the array's size, which makes every vector a second time.
    values = rows.select("letter_id", F.size("embedding").alias("size"), F.posexplode_outer("embedding").alias("position", "value"))
    return rounded(values.where(F.col("value") != 0))


AXES = 16


@query
def learnt_vectors(spark, sf):
    """The coordinates' sums of products over all letters: the variances, and nothing between two axes."""
    rows = prepared_documents(spark, sf)
    space = ts.fit_term_space(rows, ti.fit_tfidf(rows, max_features=200, ngram_range=(1, 1)), AXES)
    learnt = ts.add_learnt_vectors(rows.select("text_cleaned"), space)
    products = F.flatten(F.transform("learnt", lambda a: F.transform("learnt", lambda b: a * b)))
    sums = learnt.agg(ft.vector_to_array(Summarizer.sum(ft.array_to_vector(products))).alias("sums"))
    placed = sums.select(F.posexplode("sums").alias("place", "s"))
    cells = placed.select((F.col("place") / AXES).cast("int").alias("axis"), (F.col("place") % AXES).alias("other"), "s")
    own, first = F.element_at(F.array(*[F.lit(v) for v in space.variances]), F.col("axis") + 1), max(space.variances[0], 1e-12)
    near = F.abs(F.col("s") - F.when(F.col("axis") == F.col("other"), own).otherwise(0.0)) < 1e-7 * first
    exact = F.lit(space.error < 1e-7)
    falls = F.lit(list(space.variances) == sorted(space.variances, reverse=True))
    agreed = cells.groupBy("axis").agg(F.min(near).alias("near"))
    return agreed.select("axis", _is(F.col("near"), "has_its_variance"), _is(exact, "is_axis"), _is(falls, "falls"))


@query
def learnt_vector_cosines(spark, sf):
    """With as many axes as terms the space is only turned: the cosines are those of the TF-IDF rows."""
    rows = prepared_documents(spark, sf)
    space = ts.fit_term_space(rows, ti.fit_tfidf(rows, max_features=40, ngram_range=(1, 1)), 40)
    learnt = ts.add_learnt_vectors(rows.select("letter_id", "text_cleaned"), space)
    target = learnt.orderBy("letter_id").select("learnt").first()[0]
    weights = F.array(*[F.lit(v) for v in target])
    products = F.zip_with("learnt", weights, lambda a, b: a * b)
    cosine = F.aggregate(products, F.lit(0.0), lambda a, b: a + b)
    length = F.aggregate("learnt", F.lit(0.0), lambda a, b: a + b * b)
    return learnt.select("letter_id", (F.round(cosine, 6) + 0.0).alias("cosine"), F.round(length, 6).alias("length"))


@query
def scaled_features(spark, sf):
    rows = handcrafted_features(letters(spark, sf)).select("letter_id", *FEATURE_NAMES)
    return rounded(rows.select("letter_id", *ft.scaled(ft.fit_scaler(rows))))


@query
def feature_matrix(spark, sf):
    rows = _vector_features(spark, sf)
    matrix = ft.feature_matrix(rows, ft.fit_scaler(rows))
    values = ft.vector_to_array(F.col("features"))
    return rounded(matrix.select("letter_id", F.posexplode(values).alias("position", "value")))


@query
def class_weights(spark, sf):
    return rounded(ft.class_weights(inp.labelled(spark, sf)))


def _matrix(features: DataFrame, model: clf.TrainedClassifier) -> DataFrame:
    matrix = ft.feature_matrix(features, model.scaler)
    return matrix.select("letter_id", "class", ft.vector_to_array(F.col("features")).alias("x"))


def _own_probability(model: clf.TrainedClassifier) -> Column:
    """P(class 1) from the coefficients alone."""
    coefficients = [float(c) for c in model.model.coefficients.toArray()]
    return vx.logistic_score(F.col("x"), coefficients, float(model.model.intercept))


@query
def logistic_training(spark, sf):
    """Whether the gradient of the penalised, class-weighted loss is zero at each fitted coefficient."""
    train, _ = _splits(spark, sf)
    model = clf.train(train, "logistic", "vector")
    weights = {r["class"]: r["weight"] for r in ft.class_weights(train).collect()}
    weight = F.element_at(F.create_map(*[F.lit(v) for pair in weights.items() for v in pair]), F.col("class"))
    size = train.count()
    residual = _matrix(train, model).withColumn("r", weight * (_own_probability(model) - F.col("class")))
    ranked = clf.feature_importance(model, spark)
    n = ranked.count()
    sums = residual.agg(F.array(*[F.sum(F.col("r") * F.get("x", F.lit(i))) for i in range(n)]).alias("g"))
    slopes = sums.select(F.posexplode("g").alias("position", "slope"))
    joined = ranked.join(slopes, "position")
    gradient = (F.col("slope") + F.col("importance") / clf.INVERSE_PENALTY) / size
    return joined.select("position", "feature", _is(F.abs(gradient) < 1e-3, "is_optimal"))


@query
def forest_training(spark, sf):
    train, _ = _splits(spark, sf)
    forest = clf.train(train, "random_forest", "vector")
    ranked = clf.feature_importance(forest, spark)
    # A forest that has learnt nothing is no better than the commonest class.
    commonest = train.groupBy("class").count().agg(F.max("count")).first()[0] / train.count()
    learnt = clf.evaluate(forest, train).first()["accuracy"] > commonest + 0.05
    total = F.round(F.sum("importance").over(Window.partitionBy()), 6)
    return ranked.select("position", "feature", _is(F.col("importance").between(0, 1), "in_range"), total.alias("total"), _is(F.lit(learnt), "has_learnt"))


@query
def train_with_folds(spark, sf):
    """Rows of each fold and class; whether each fold's score and the record on the training rows hold."""
    train, _ = _splits(spark, sf)
    model = clf.train(train, "logistic", "vector")
    scores = clf.cross_validate(train, parallelism=4)
    record = clf.training_record(model, train, scores).first()
    guess = _matrix(train, model).select(F.col("class").alias("y"), (_own_probability(model) > 0.5).cast("int").alias("p"))
    own = mt.comprehensive_metrics(guess).first()
    held = {r["fold"]: r["f1_weighted"] for r in scores.collect()}
    mean = sum(held.values()) / len(held)
    names = (("train_accuracy", "accuracy"), ("train_precision", "precision_weighted"), ("train_recall", "recall_weighted"), ("train_f1", "f1_weighted"))
    agrees = all(abs(record[a] - own[b]) < 1e-9 for a, b in names) and abs(record["cv_f1_mean"] - mean) < 1e-9
    dealt = rk.stratified_folds(train.select("letter_id", "class")).groupBy("fold", "class").agg(F.count("*").alias("n"))
    scored = F.col("fold").isin([f for f, value in held.items() if 0 < value <= 1])
    return dealt.select("fold", "class", "n", _is(scored, "is_scored"), F.lit(int(agrees)).alias("record_agrees"))


def _scaled_rows(rows, scaler):
    return ft.feature_matrix(rows, scaler).select("*", ft.vector_to_array(F.col("features")).alias("x"))


@query
def folds_in_one_scan(spark, sf):
    """Rows of each fold and class; whether the fold's fit has no slope left, and its score is that of its predictions."""
    train, _ = _splits(spark, sf)
    dealt = rk.stratified_folds(train.where(F.col("class").isNotNull())).persist(StorageLevel.MEMORY_AND_DISK)
    counted = dealt.groupBy("fold", "class").agg(F.count("*").alias("n")).collect()
    fits, scaler = clf.fit_folds(dealt, counted), ft.fit_scaler(dealt)
    scores = {r["fold"]: r["f1_weighted"] for r in clf.cross_validate(train).collect()}
    rows = _scaled_rows(dealt, scaler)
    found = []
    for fold, fit in fits.items():
        score = vx.logistic_score(F.col("x"), fit.coefficients, fit.intercept)
        weight = F.element_at(F.array(*[F.lit(w) for w in fit.plan.weights]), F.col("class") + 1)
        error = weight * (score - F.col("class"))
        inside = rows.where(F.col("fold") != fold).select(F.transform("x", lambda v: v * error).alias("g"), error.alias("e"))
        sums = inside.agg(F.array(*[F.sum(F.get("g", F.lit(i))) for i in range(len(fit.coefficients))]).alias("g"), F.sum("e").alias("e")).first()
        slope = max(abs(g + w) for g, w in zip([*sums["g"], sums["e"]], [*fit.coefficients, 0.0], strict=True)) / fit.plan.rows
        outside = rows.where(F.col("fold") == fold).select(F.col("class").alias("y"), (score > 0.5).cast("int").alias("p"))
        own = mt.comprehensive_metrics(outside).first()["f1_weighted"]
        found.append((fold, int(slope < 1e-7), int(abs(own - scores[fold]) < 1e-9)))
    dealt.unpersist()
    flags = spark.createDataFrame(found, "fold int, is_optimal int, is_its_score int")
    return spark.createDataFrame(counted, "fold int, class int, n bigint").join(flags, "fold")


@query
def held_out_curve(spark, sf):
    """The first step, where all coefficients are zero; the last beside the metrics of the fit's own predictions."""
    train, test = _splits(spark, sf)
    curve, fit, scaler = clf.held_out_curve(train, test)
    steps = [r.asDict() for r in curve.orderBy("iteration").collect()]
    names = (("accuracy", "accuracy"), ("precision", "precision_weighted"), ("recall", "recall_weighted"))
    agrees = True
    for rows, prefix in ((train, ""), (test, "val_")):
        score = vx.logistic_score(F.col("x"), fit.coefficients, fit.intercept)
        judged = _scaled_rows(rows, scaler).select(F.col("class").alias("y"), (score > 0.5).cast("int").alias("p"))
        own = mt.comprehensive_metrics(judged).first()
        agrees &= all(abs(steps[-1][prefix + a] - own[b]) < 1e-9 for a, b in names)
    falls = steps[-1]["loss"] < steps[0]["loss"] and fit.converged
    shown = [prefix + name for prefix in ("", "val_") for name in ("loss", "accuracy", "precision", "recall")]
    first = curve.where(F.col("iteration") == 0).select("iteration", *shown)
    return rounded(first).select("*", _is(F.lit(agrees), "last_agrees"), _is(F.lit(falls), "falls"))


def _checked_predictions(model, rows):
    found = clf.predict(model, rows).select("letter_id", "prediction", "probability_0", "probability_1")
    joined = _matrix(rows, model).join(found, "letter_id")
    own = _own_probability(model)
    close = (F.abs(own - F.col("probability_1")) < 1e-9) & (F.abs(F.col("probability_0") + F.col("probability_1") - 1) < 1e-9)
    return joined.select("letter_id", "class", _is(close & ((own > 0.5).cast("int") == F.col("prediction")), "agrees"))


@query
def predict_letters(spark, sf):
    """Predictions beside those of the coefficients."""
    train, test = _splits(spark, sf)
    return _checked_predictions(clf.train(train, "logistic", "vector"), test)


@query
def save_and_load_model(spark, sf):
    """Predictions of the loaded model beside those of the coefficients of the saved one."""
    train, test = _splits(spark, sf)
    path = sink.work_folder(spark)
    model = clf.train(train, "logistic", "vector")
    clf.save_classifier(model, spark, path)
    loaded = clf.load_classifier(spark, path)
    same = (loaded.kind, loaded.vector_source, loaded.scaler) == (model.kind, model.vector_source, model.scaler)
    before, after = clf.predict(model, test), clf.predict(loaded, test).select("letter_id", F.col("probability_1").alias("after"))
    joined = before.join(after, "letter_id")
    return joined.select("letter_id", "class", _is((F.col("after") == F.col("probability_1")) & F.lit(same), "agrees"))


@query
def score_with_coefficients(spark, sf):
    rows = inp.table(spark, sf, "embeddings")
    p = vx.logistic_score(F.col("embedding"), COEFFICIENTS, -0.25)
    scored = rows.select("vec_id", p.alias("probability"))
    return rounded(scored.withColumn("prediction", (F.col("probability") > 0.5).cast("int")))


@query
def evaluate_predictions(spark, sf):
    return rounded(mt.evaluation(inp.predictions(spark, sf), "score"))


@query
def feature_importance(spark, sf):
    """Features by the size of their coefficient, the largest first."""
    train, _ = _splits(spark, sf)
    model = clf.train(train, "logistic", "vector")
    ranked = clf.feature_importance(model, spark).orderBy(F.desc(F.abs("importance")), "position")
    coefficients = F.array(*[F.lit(float(c)) for c in model.model.coefficients.toArray()])
    return ranked.select("position", "feature", _is(F.col("importance") == F.get(coefficients, F.col("position")), "is_coefficient"))


@query
def training_curve(spark, sf):
    """Where the curve starts, and whether its loss falls from step to step and in all."""
    train, _ = _splits(spark, sf)
    curve = clf.training_curve(clf.train(train, "logistic", "vector"), spark)
    order = Window.orderBy("iteration")  # a row for each iteration, at most MAX_ITERATIONS
    steps = curve.withColumns({"before": F.lag("loss").over(order), "place": F.row_number().over(order) - 1})
    return steps.agg(
        F.min("iteration").alias("first_iteration"),
        _is(F.bool_and(F.coalesce(F.col("loss") <= F.col("before") + 1e-12, F.lit(True))), "never_rises"),
        _is(F.bool_and(F.col("iteration") == F.col("place")), "is_numbered"),
        _is(F.min_by("loss", "iteration") > F.max_by("loss", "iteration"), "falls"),
    )


# --- metrics ------------------------------------------------------------------------------


@query
def comprehensive_metrics(spark, sf):
    return rounded(mt.comprehensive_metrics(inp.predictions(spark, sf)))


@query
def confusion_rates(spark, sf):
    return rounded(mt.confusion_rates(inp.predictions(spark, sf)))


@query
def roc_auc(spark, sf):
    return rounded(mt.roc_auc(inp.predictions(spark, sf)))


@query
def confusion_matrix(spark, sf):
    return mt.confusion_matrix(inp.predictions(spark, sf))


@query
def class_performance(spark, sf):
    return rounded(mt.class_performance(inp.predictions(spark, sf)))


@query
def compare_runs(spark, sf):
    return rounded(rn.compare_runs(inp.runs(spark, sf)))


def _verdict(df):
    return rounded(df.withColumn("significant", F.col("significant").cast("int")))


@query
def paired_t_test(spark, sf):
    return _verdict(sg.significance(inp.pairs(spark, sf), "paired_t"))


@query
def wilcoxon_test(spark, sf):
    return _verdict(sg.significance(inp.pairs(spark, sf), "wilcoxon"))


@query
def mcnemar_test(spark, sf):
    return rounded(sg.mcnemar(inp.predictions(spark, sf)))


def _off_the_half(p: Column) -> Column:
    """Exact p-values are sums of powers of a half and may lie midway between two roundings."""
    return p + 1e-9


@query
def wilcoxon_exact(spark, sf):
    found = sg.wilcoxon_exact(inp.pairs(spark, sf)).drop("test_type")
    return _verdict(found.withColumns({"exact": F.col("exact").cast("int"), "p_value": _off_the_half(F.col("p_value"))}))


@query
def mcnemar_exact(spark, sf):
    found = sg.mcnemar_p(inp.predictions_by_supplier(spark, sf), ["l_suppkey"])
    return _verdict(found.withColumn("p_value", _off_the_half(F.col("p_value"))))


@query
def improvement_over_baseline(spark, sf):
    rows = rn.improvements(inp.runs(spark, sf))
    return rounded(rows.withColumn("is_better", F.col("is_better").cast("int")))


@query
def improvement_level(spark, sf):
    return rounded(rn.improvement_levels(inp.runs(spark, sf)))


# --- experiments and presentation ------------------------------------------------------------


def _document_splits(spark, sf):
    rows = documents(spark, sf).select("letter_id", "guarantee_letter_text", "class")
    split = inp.split_of(F.col("letter_id"))
    return rows.where(split == "train"), rows.where(split == "test")


@query
def load_and_analyze(spark, sf):
    train, test = _document_splits(spark, sf)
    path = sink.work_folder(spark)
    return _saved_sections(spark, analysis.load_and_analyze(train, test, DOC, path)[2], path)


def _saved_sections(spark, sections, path):
    """All sections of an analysis, as they were saved."""
    saved = {name: spark.read.schema(df.schema).json(f"{path}/{name}") for name, df in sections.items()}
    return rounded(analysis.as_long(saved))


def _experiment(spark, sf, vectors="hashing"):
    if vectors == "hashing":
        train, test = _letter_splits(spark, sf)
    else:
        rows = inp.embeddings(spark, sf)
        train, test = rows.where(F.col("split") == "train"), rows.where(F.col("split") == "test")
    return experiments.Prepared(train, test, vectors, DEFAULT, parallelism=4)


def _letter_splits(spark, sf):
    rows = letters(spark, sf)
    split = inp.split_of(F.col("letter_id"))
    return rows.where(split == "train"), rows.where(split == "test")


def _audited(runs):
    """Runs with their sizes, and whether their numbers hold together.

    All metrics must follow from the confusion matrix, the matrix must hold the test letters, every run must be
    cross-validated, and a useful model is right more often than wrong.
    """
    again = mt.metrics_from_cells(runs.select("run_id", "tn", "fp", "fn", "tp"), absent=0.0)
    shown = ("accuracy", "f1_weighted", "precision_weighted", "recall_weighted", "precision_class_0", "recall_class_0", "f1_class_0", "precision_class_1", "recall_class_1", "f1_class_1")
    other = again.select("run_id", *[F.col(m).alias(f"own_{m}") for m in shown])
    same = F.lit(True)
    for m in shown:
        same &= F.abs(F.col(m) - F.col(f"own_{m}")) < 1e-9
    validated = F.col("cv_f1_mean").between(0, 1) & F.col("cv_f1_std").between(0, 1) & F.col("train_f1").between(0, 1)
    return runs.join(other, "run_id").select(
        "run_id",
        "family",
        "size",
        "train_size",
        "test_size",
        (F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")).alias("cells"),
        F.coalesce(F.round("real_synthetic_ratio", 6), F.lit(0.0)).alias("ratio"),
        _is(same, "metrics_follow"),
        _is(validated, "is_validated"),
        _is(F.col("mean_prob_class_1").between(0, 1), "has_probability"),
        _is(F.col("mean_quality").between(0, 1) | (F.col("family") != "generated"), "has_quality"),
    )


def _released(data, runs):
    kept = _kept(_audited(runs))
    data.release()
    return kept


@query
def baseline_experiment(spark, sf):
    data = _experiment(spark, sf, "vector")
    return _released(data, experiments.baseline(data))


@query
def baseline_learnt(spark, sf):
    """The baseline with vectors learnt from the training letters."""
    train, test = _letter_splits(spark, sf)
    data = experiments.Prepared(train, test, ts.learnt_space(train, 32, 300), DEFAULT, parallelism=4)
    return _released(data, experiments.baseline(data))


@query
def augmentation_experiment(spark, sf):
    data = _experiment(spark, sf)
    return _released(data, experiments.synthetic_augmentation(data))


@query
def generated_experiment(spark, sf):
    data = _experiment(spark, sf)
    return _released(data, experiments.generated_augmentation(data, _answers(spark, sf)))


@query
def classifier_comparison(spark, sf):
    data = _experiment(spark, sf, "vector")
    return _released(data, experiments.classifier_comparison(data))


LABEL = "20240101_000000"


def _full_run(spark, sf):
    path = sink.work_folder(spark)
    experiments.run_full(*_letter_splits(spark, sf), _answers(spark, sf), path=path, run_label=LABEL, parallelism=4)
    return path


@query
def full_suite(spark, sf):
    return _audited(sink.latest_runs(spark, _full_run(spark, sf), experiments.RUN_SCHEMA))


def _saved_mode(spark, path):
    """What a mode has saved: its runs, its sections, and its report with # for every number."""
    runs = spark.read.schema(experiments.RUN_SCHEMA).json(f"{path}/experiment_{LABEL}")
    tested = sink.read_predictions(spark, f"{path}/models_{LABEL}").groupBy("run_id").agg(F.count("*").alias("n"))
    report = spark.read.text(f"{path}/report_{LABEL}").select(F.regexp_replace("value", "[+-]*[0-9]+([.][0-9]+)?", "#").alias("value"))
    distribution = spark.read.schema("class int, count bigint").json(f"{path}/analysis_{LABEL}/class_distribution")
    rows = [
        runs.select(F.lit("run").alias("what"), F.col("run_id").alias("item"), F.col("train_size").alias("n")),
        tested.select(F.lit("predictions").alias("what"), F.col("run_id").alias("item"), "n"),
        report.select(F.lit("report").alias("what"), F.col("value").alias("item"), F.lit(1).cast("bigint").alias("n")),
        distribution.select(F.lit("class").alias("what"), F.col("class").cast("string").alias("item"), F.col("count").alias("n")),
    ]
    return pf.union_all(rows)


@query
def analysis_mode(spark, sf):
    train, test = _letter_splits(spark, sf)
    path = sink.work_folder(spark)
    return _saved_sections(spark, experiments.run_analysis(train, test, path=path), path)


@query
def baseline_mode(spark, sf):
    path = sink.work_folder(spark)
    experiments.run_baseline(*_letter_splits(spark, sf), path=path, run_label=LABEL, parallelism=4)
    return _saved_mode(spark, path)


@query
def synthetic_mode(spark, sf):
    path = sink.work_folder(spark)
    experiments.run_synthetic(*_letter_splits(spark, sf), path=path, run_label=LABEL, parallelism=4)
    return _saved_mode(spark, path)


@query
def full_mode(spark, sf):
    path = _full_run(spark, sf)
    matrix = spark.read.schema("y int, p int, count bigint").json(f"{path}/dashboard_{LABEL}/baseline_confusion_matrix")
    tested = matrix.agg(F.sum("count").alias("n"))
    return _saved_mode(spark, path).unionByName(tested.select(F.lit("dashboard").alias("what"), F.lit("matrix").alias("item"), "n"))


@query
def run_summary(spark, sf):
    return rounded(rn.run_summary(inp.runs(spark, sf)))


@query
def results_table(spark, sf):
    return rounded(rn.results_table(inp.runs(spark, sf)))


@query
def class_distribution_series(spark, sf):
    return rounded(pf.class_distribution(inp.labelled(spark, sf)))


@query
def metric_series(spark, sf):
    return rounded(rn.metric_series(inp.runs(spark, sf)))


@query
def ablation_series(spark, sf):
    return rounded(rn.ablation_series(inp.runs(spark, sf)))


@query
def confusion_cells(spark, sf):
    names = F.array(F.lit("Общие запросы"), F.lit("Специфические коды"))
    cells = mt.confusion_matrix(inp.predictions(spark, sf))
    return cells.select(F.get(names, F.col("y")).alias("truth"), F.get(names, F.col("p")).alias("guess"), "count")


@query
def dashboard(spark, sf):
    tables = rn.dashboard(inp.runs(spark, sf), mt.confusion_matrix(inp.predictions(spark, sf)))
    return rounded(analysis.as_long(tables))
