"""Preprocessing as a stage, so that a stored model takes raw documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .preprocess import OPTIMAL, preprocess


class Preprocessor(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Adds ``tokens``, the token bag of ``fields``; every input column stays.

    Pure column work (see :func:`preprocess`), so it runs in batch and streams.
    """

    fields = Param(Params._dummy(), "fields", "fields to use", TypeConverters.toListString)
    ngram = Param(Params._dummy(), "ngram", "longest n-gram", TypeConverters.toInt)
    stopWords = Param(Params._dummy(), "stopWords", "words to drop", TypeConverters.toListString)
    lexicon = Param(Params._dummy(), "lexicon", "words to mask", TypeConverters.toListString)
    mode = Param(Params._dummy(), "mode", "tokeniser: words or full", TypeConverters.toString)
    key = Param(Params._dummy(), "key", "key column", TypeConverters.toString)

    @keyword_only
    def __init__(
        self,
        *,
        fields: Sequence[str] = OPTIMAL,
        ngram: int = 1,
        stopWords: Sequence[str] = (),
        lexicon: Sequence[str] = (),
        mode: str = "full",
        key: str = "pmid",
    ) -> None:
        super().__init__()
        self._setDefault(fields=list(OPTIMAL), ngram=1, stopWords=[], lexicon=[], mode="full", key="pmid")
        self._set(**{k: list(v) if isinstance(v, tuple) else v for k, v in self._input_kwargs.items()})

    def _transform(self, df: DataFrame) -> DataFrame:
        get = self.getOrDefault
        row = F.struct(*[F.col(c) for c in df.columns]).alias("_row")
        # The whole input row travels in one struct beside the fields at work.
        names = list(dict.fromkeys([get(self.key), *get(self.fields)]))
        bags = preprocess(
            df.select(*names, row),
            get(self.fields),
            get(self.ngram),
            get(self.stopWords),
            get(self.lexicon),
            get(self.mode),
            key=get(self.key),
            keep=["_row"],
        )
        return bags.select(*[F.col("_row").getField(c).alias(c) for c in df.columns], "tokens")


def with_preprocessor(model: PipelineModel, stage: Preprocessor) -> PipelineModel:
    """A model that starts from raw fields."""
    return PipelineModel([stage, *model.stages])


def takes_raw_documents(model: PipelineModel) -> bool:
    return isinstance(model.stages[0], Preprocessor)
