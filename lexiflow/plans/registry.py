"""Name -> (Spark query, oracle SQL or None).  A ``None`` oracle means the
result is not expressible in SQL (fitted models, iterative solvers); the
query is then checked by invariants in the tests."""

from __future__ import annotations

from . import bindings as B
from . import oracle as O
from . import text_oracle as TO
from . import text_queries as TQ
from . import table_oracle as RO
from . import table_queries as RQ

# (spark module, sql module, names)
GROUPS = [
    (B, O, ["nb_lang_report", "nb_lang_predict", "nb_lang_scores", "nb_lang_model",
            "nb_multi_predict", "nb_duplicate_keys", "nb_drop_top", "nb_bigram_predict", "token_counts", "log_priors",
            "nb_top_tokens"]),
    (TQ, TO, ["clean_text_basic", "clean_text_symbols", "normalize_tokens", "dedupe_clean",
              "dropna_fill", "canonical_category", "ngrams", "vocabulary", "bucket_counts",
              "tfidf_long", "lexicon_sentiment", "adjust_label", "adjust_counts",
              "dictionary_annotate", "dictionary_rewrite", "sequence_encode", "stop_anti_join"]),
    (RQ, RO, ["confusion", "class_report", "macro_micro_precision", "accuracy_by_target",
              "off_by_histogram", "mae_by_target", "regression_metrics", "mape_score",
              "feature_corr", "feature_cov", "corr_matrix", "corr_top_n", "corr_threshold",
              "cross_entropy", "argmax_accuracy", "factorize", "factorize_codes", "minmax_scale",
              "standard_scale", "hash_split", "stratified_folds", "undersample", "value_counts",
              "json_decode_defaults", "json_encode", "tail_n", "head_n", "knn_neighbors", "knn_tree_events",
              "knn_classify", "knn_classify_weighted", "smote", "smote_class_counts"]),
]

from . import model_queries as MQ
from . import stream_queries as SQ


class _Alias:
    """Oracle module view that maps a query name to another query's SQL."""

    def __init__(self, mapping):
        self.mapping = mapping

    def __getattr__(self, name):
        return self.mapping[name]


STREAM_SQL = _Alias({"nb_incremental": O.token_counts, "nb_stream_predict": O.nb_multi_predict})
GROUPS.append((SQ, STREAM_SQL, ["nb_incremental", "nb_stream_predict"]))

from . import closed_form_queries as CF
from . import context_queries as XQ
from . import review_queries as VQ
from . import source_queries as FQ
for _module in (CF, VQ, XQ, FQ):
    GROUPS.append((_module, _Alias(_module.SQL), list(_module.SQL)))

# (module, name) pairs checked by row counts and invariants only
NO_ORACLE: list = [(MQ, n) for n in [
    "pca_explained", "pca_project", "lr_fit_score", "lr_tfidf", "rf_importance", "rf_regress",
    "tree_classify", "gbt_multi", "mlp_embed", "rfe_select", "grid_search", "random_search",
    "cv_scores", "sampling_experiment"]]


def spark_queries():
    out = {}
    for mod, _sql, names in GROUPS:
        for n in names:
            out[n] = getattr(mod, n)
    for mod, n in NO_ORACLE:
        out[n] = getattr(mod, n)
    return out


def sql_queries():
    out = {}
    for _mod, sql, names in GROUPS:
        for n in names:
            out[n] = getattr(sql, n)()
    return out
