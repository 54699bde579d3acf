"""Per-review sentiment enrichers (2-G): lexicon and hybrid sentiment, model scorer
slots (Arrow iterator UDFs), aspects with context sentiment, the one-select
``enrich_sentiment``, and a trainable toxicity baseline on labelled text."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import hashlib

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plaudit import lexicons as L
from plaudit.functions import (aspect_context, count_contained, lang_code, lexicon_outcome,
                               lexicon_sentiment, normalize_vote, sentiment_label, text_or_empty)
from plaudit.operators.valence import label_odds, learn_valences

# ------------------------------------------------------------------ lexicon / hybrid


def with_lexicon_sentiment(df: DataFrame, positive: Sequence[str] = L.LEXICON_POSITIVE,
                           negative: Sequence[str] = L.LEXICON_NEGATIVE,
                           col: str = "review") -> DataFrame:
    d = df.withColumn("_low", F.lower(text_or_empty(col)))
    d = d.withColumns({"_pos": count_contained(F.col("_low"), positive),
                       "_neg": count_contained(F.col("_low"), negative)})
    s = lexicon_outcome("_pos", "_neg")
    return d.withColumn("_lex", s).withColumns({
        "sentiment_label": F.col("_lex.label"), "sentiment_confidence": F.col("_lex.score"),
        "sentiment_score": F.col("_lex.compound")}).drop("_lex", "_low", "_pos", "_neg")


def hybrid_sentiment(df: DataFrame, scorer: Callable[[Column], Column] | None = None,
                     lang_col: str = "language", col: str = "review") -> DataFrame:
    """English rows: compound score of ``scorer`` (default: lexicon compound);
    other languages: the vote as 1.0 / 0.0. Adds label and confidence."""
    scorer = scorer or (lambda c: lexicon_sentiment(c).getField("compound"))
    is_en = lang_code(lang_col) == F.lit("en")
    score = F.when(is_en, scorer(col)).otherwise(normalize_vote("voted_up").cast("double"))
    return df.withColumn("sentiment_score", score).withColumns({
        "sentiment_label": sentiment_label("sentiment_score"),
        "sentiment_confidence": F.abs("sentiment_score")})


# ------------------------------------------------------------------ model slots

_MODELS: dict = {}
CHUNK = 256   # rows of an Arrow batch whose texts are Python strings at a time

SCORE_FIELDS = [T.StructField("label", T.StringType()), T.StructField("score", T.DoubleType()),
                T.StructField("scored", T.BooleanType())]
SCORE_SCHEMA = T.StructType(SCORE_FIELDS)


def loaded_model(name: str, loader: Callable):
    """The model of that name in this Python worker; ``loader`` runs on first use and
    later tasks of the worker find the model here. (UDF bodies are shipped by value,
    this module is not, so the cache is the worker's.)"""
    if name not in _MODELS:
        _MODELS[name] = loader()
    return _MODELS[name]


def loader_name(loader: Callable) -> str:
    """A name that is the same wherever the same loader is used."""
    return hashlib.sha256(cloudpickle.dumps(loader)).hexdigest()


def score_texts(texts: list, loader: Callable, name: str, batch_size: int, max_chars: int | None,
                fallback: tuple[str, float] | None) -> list[tuple]:
    """(label, score, scored) per text; null texts are not scored: (None, None, False)."""
    out: list[tuple] = [(None, None, False)] * len(texts)
    at = [k for k, t in enumerate(texts) if t is not None]
    if not at:
        return out
    for i in range(0, len(at), batch_size):
        some = at[i:i + batch_size]
        try:
            got = loaded_model(name, loader)([texts[k][:max_chars] for k in some])
            if len(got) != len(some):
                raise ValueError(f"the model gave {len(got)} results for {len(some)} texts")
        except Exception:
            if fallback is None:
                raise
            got = None
        for n, k in enumerate(some):
            out[k] = (*fallback, False) if got is None else (str(got[n][0]).lower(), float(got[n][1]), True)
    return out


def model_scores(inputs: dict[str, Column], loaders: dict[str, Callable], batch_size: int = 32,
                 max_chars: int | None = None, fallback: tuple[str, float] | None = None,
                 where: dict[str, Column] | None = None) -> Column:
    """One pass of an Arrow iterator UDF around user models: a struct per model name
    with (label, score, scored).

    ``loaders[name]()`` runs once per Python worker and returns ``predict(texts)``,
    giving one (label, score) per text; ``inputs[name]`` is its text column (null: not
    scored), ``where[name]`` a condition that its rows must meet to be scored. Models with
    the same column object share it: its texts go to Python once, and only those of
    ``CHUNK`` rows are Python strings at a time. Texts are passed whole unless
    ``max_chars`` is given. A failing load or batch raises, unless ``fallback`` is given:
    its rows then carry it with ``scored = false``.
    """
    names, where = list(loaders), where or {}
    keys = {n: loader_name(loaders[n]) for n in names}
    columns = {id(inputs[n]): inputs[n] for n in names}
    field = {n: f"c{list(columns).index(id(inputs[n]))}" for n in names}
    schema = T.StructType([T.StructField(n, SCORE_SCHEMA) for n in names])
    fields = pa.struct([("label", pa.string()), ("score", pa.float64()), ("scored", pa.bool_())])
    step = max(1, CHUNK // batch_size) * batch_size
    masks = list(where)

    def scores(part: pa.StructArray) -> pa.StructArray:
        texts = {f: part.field(f).to_pylist() for f in set(field.values())}
        asked = {n: part.field(f"m_{masks.index(n)}").to_pylist() for n in masks}
        out = []
        for n in names:
            own = [None if t is None else str(t) for t in texts[field[n]]]
            if n in asked:
                own = [t if m else None for t, m in zip(own, asked[n])]
            got = score_texts(own, loaders[n], keys[n], batch_size, max_chars, fallback)
            out.append(pa.array([{"label": a, "score": b, "scored": c} for a, b, c in got], fields))
        return pa.StructArray.from_arrays(out, names)

    @F.arrow_udf(schema)
    def _score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:  # pragma: no cover
        for whole in batches:
            parts = [scores(whole.slice(i, step)) for i in range(0, len(whole), step)]
            yield pa.concat_arrays(parts) if parts else scores(whole)

    return _score(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(columns.values())],
                           *[where[n].alias(f"m_{i}") for i, n in enumerate(masks)]))


def _english(lang_col: str) -> Column:
    return lang_code(lang_col) == F.lit("en")


def with_models(df: DataFrame, loaders: dict, col: str = "review", lang_col: str = "language",
                fallback: tuple[str, float] | None = None) -> DataFrame:
    """Column ``_models`` with the outputs of all given models, from one pass of the
    texts through Python. Emotion sees English texts only."""
    given = {n: f for n, f in loaders.items() if f is not None}
    if not given:
        return df
    text = F.coalesce(F.col(col), F.lit(""))
    english = {"emotion": _english(lang_col)} if "emotion" in given else {}
    return df.withColumn("_models", model_scores(dict.fromkeys(given, text), given, fallback=fallback, where=english))


def _given(df: DataFrame, name: str, loader, col: str, lang_col: str = "language") -> DataFrame:
    """``df`` with ``_models.<name>`` when there is a loader and no earlier pass."""
    if loader is None or "_models" in df.columns:
        return df
    return with_models(df, {name: loader}, col, lang_col)


def model_sentiment(df: DataFrame, loader=None, col: str = "review") -> DataFrame:
    """label / confidence / compound (= +score, -score or 0) from a sentiment model;
    without a model the lexicon fallback of the original is used."""
    if loader is None:
        return with_lexicon_sentiment(df, col=col)
    m = F.col("_models.sentiment")
    comp = F.when(m.label == "positive", m.score).when(m.label == "negative", -m.score).otherwise(F.lit(0.0))
    out = _given(df, "sentiment", loader, col).withColumns({
        "sentiment_label": m.label, "sentiment_confidence": m.score, "sentiment_score": comp})
    return out if "_models" in df.columns else out.drop("_models")


def emotion(df: DataFrame, loader=None, col: str = "review", lang_col: str = "language") -> DataFrame:
    """Top emotion label; non-English -> ('unknown', 0) and never sent to the model;
    no model -> ('neutral', 0)."""
    is_en = _english(lang_col)
    m = F.col("_models.emotion")
    lab, sc = (F.lit("neutral"), F.lit(0.0)) if loader is None else (m.label, m.score)
    out = _given(df, "emotion", loader, col, lang_col).withColumns({
        "emotion_type": F.when(is_en, lab).otherwise(F.lit("unknown")),
        "emotion_score": F.when(is_en, sc).otherwise(F.lit(0.0))})
    return out if "_models" in df.columns else out.drop("_models")


def _flag_model(df: DataFrame, name: str, loader, positive_labels: Sequence[str], flag: str, score: str,
                col: str) -> DataFrame:
    if loader is None:
        return df.withColumns({flag: F.lit(False), score: F.lit(0.0)})
    m = F.col(f"_models.{name}")
    hit = m.label.isin(list(positive_labels))
    out = _given(df, name, loader, col).withColumns({
        flag: F.when(m.scored, hit).otherwise(F.lit(False)),
        score: F.when(~m.scored, F.lit(0.0)).when(hit, m.score).otherwise(1 - m.score)})
    return out if "_models" in df.columns else out.drop("_models")


def sarcasm(df: DataFrame, loader=None, col: str = "review") -> DataFrame:
    return _flag_model(df, "sarcasm", loader, ["sarcasm", "1"], "is_sarcasm", "sarcasm_score", col)


def toxicity(df: DataFrame, loader=None, col: str = "review") -> DataFrame:
    return _flag_model(df, "toxicity", loader, ["toxic", "1"], "is_toxic", "toxicity_score", col)


def keyword_model_loader(words: Sequence[str], hit: str, miss: str, sure: float = 0.8):
    """A small model for the slots: label ``hit`` when a text holds any of the words."""
    words = list(words)

    def load():
        return lambda texts: [(hit, sure) if any(w in t.lower() for w in words) else (miss, sure) for t in texts]
    return load


def lexicon_model_loader(positive: Sequence[str] = tuple(L.LEXICON_POSITIVE),
                         negative: Sequence[str] = tuple(L.LEXICON_NEGATIVE)):
    """A stand-in 'model' for the scorer slot: returns the loader of a lexicon
    classifier (label, confidence). Used to exercise and test the Arrow path."""
    pos, neg = list(dict.fromkeys(positive)), list(dict.fromkeys(negative))

    def load():
        def predict(texts):
            out = []
            for t in texts:
                lo = t.lower()
                p = sum(1 for w in pos if w in lo)
                n = sum(1 for w in neg if w in lo)
                out.append(("positive", 0.7) if p > n else ("negative", 0.7) if n > p
                           else ("neutral", 0.5))
            return out
        return predict
    return load


# ------------------------------------------------------------------ aspects

def _with_lower(df: DataFrame, col: str) -> DataFrame:
    # lower-cased text as a column so that list lambdas reference it, not re-run it
    return df.withColumn("_low", F.lower(text_or_empty(col)))


def _matched(words: Sequence[str]) -> Column:
    """Distinct list words contained in ``_low``, in list order. Written as an array
    of conditional literals (codegen'd byte search), not a lambda over the list."""
    ws = list(dict.fromkeys(words))
    return F.array_compact(F.array(*[F.when(F.col("_low").contains(w), F.lit(w)) for w in ws]))


def aspect_mentions(df: DataFrame, col: str = "review", aspects: dict | None = None,
                    keys: Sequence[str] = ("recommendation_id",)) -> DataFrame:
    """Long form: one row per review and mentioned aspect with its matched keywords
    (distinct, in list order)."""
    aspects = aspects or L.ASPECTS
    d = _with_lower(df, col)
    m = F.create_map(*[x for a, ws in aspects.items() for x in (F.lit(a), _matched(ws))])
    out = d.select(*keys, F.explode(m).alias("aspect", "kw")).where(F.size("kw") > 0)
    return out.select(*keys, "aspect", F.array_join("kw", ",").alias("keywords"))


def aspect_columns(df: DataFrame, col: str = "review", aspects: dict | None = None) -> DataFrame:
    """Wide aspect sentiment: ``aspect_<a>_sentiment`` ('none' when not mentioned) and
    ``aspect_<a>_score`` (0.0), from the lexicon sentiment of the context window
    around the first listed matched keyword.

    Built in stages (matched keywords -> context -> hit counts -> labels), each a
    column the next stage references, so the optimizer never inlines one aspect's
    context into dozens of containment tests.
    """
    aspects = aspects or L.ASPECTS
    names = list(aspects)
    d = _with_lower(df, col)
    d = d.withColumns({f"_kw_{i}": _matched(aspects[a]) for i, a in enumerate(names)})
    d = d.withColumn("_len", F.length(text_or_empty(col)))
    d = d.withColumns({f"_ctx_{i}": F.lower(aspect_context(col, F.col(f"_kw_{i}"),
                                                           lowered=F.col("_low"),
                                                           length=F.col("_len")))
                       for i in range(len(names))})
    cnt = {}
    for i in range(len(names)):
        cnt[f"_p_{i}"] = count_contained(F.col(f"_ctx_{i}"), L.LEXICON_POSITIVE)
        cnt[f"_n_{i}"] = count_contained(F.col(f"_ctx_{i}"), L.LEXICON_NEGATIVE)
    d = d.withColumns(cnt)
    cols = {}
    for i, a in enumerate(names):
        s = lexicon_outcome(f"_p_{i}", f"_n_{i}")
        mentioned = F.size(F.col(f"_kw_{i}")) > 0
        cols[f"aspect_{a}_sentiment"] = F.when(mentioned, s.getField("label")).otherwise(F.lit("none"))
        cols[f"aspect_{a}_score"] = F.when(mentioned, s.getField("compound")).otherwise(F.lit(0.0))
    tmp = ["_low", "_len"] + [f"_{k}_{i}" for k in ("kw", "ctx", "p", "n") for i in range(len(names))]
    return d.withColumns(cols).drop(*tmp)


def enrich_sentiment(df: DataFrame, col: str = "review", lang_col: str | None = None,
                     loaders: dict | None = None) -> DataFrame:
    """All per-review sentiment columns in one projection: label, score,
    confidence, emotion x2, sarcasm x2, toxicity x2 and the 20 aspect columns.
    Without loaders every model falls back to the original's constants / lexicon."""
    loaders = loaders or {}
    own = df.columns
    lang_col = lang_col or ("detected_language" if "detected_language" in df.columns else "language")
    out = model_sentiment(with_models(df, loaders, col, lang_col), loaders.get("sentiment"), col)
    out = emotion(out, loaders.get("emotion"), col, lang_col)
    out = sarcasm(out, loaders.get("sarcasm"), col)
    out = toxicity(out, loaders.get("toxicity"), col)
    return aspect_columns(out.drop("_models") if "_models" not in own else out, col)


# ------------------------------------------------------------------ toxicity baseline

def train_toxicity_baseline(labelled: DataFrame, text_col: str = "text", label_col: str = "toxic"):
    """Words that mark labelled toxic texts (z of 4 or more, as many words are tested at
    once), with their log-odds, and the labelled rows for the prior; see ``valence``."""
    return learn_valences(labelled, text_col, label_col, least_z=4.0), labelled.select(label_col)


def apply_toxicity_baseline(model, df: DataFrame, text_col: str = "review") -> DataFrame:
    lexicon, labelled = model
    out = label_odds(df, lexicon, labelled, labelled.columns[0], text_col, "toxicity_score")
    return out.withColumn("is_toxic", F.col("toxicity_score") >= 0.5)
