"""Operators: analyzers and what they compute."""

from dqengine.operators.base import AnalyzerOptions, FilteredRow, NullBehavior
from dqengine.operators.frequency import CountDistinct, Distinctness, DuplicateRowCount, Entropy, MutualInformation, Uniqueness, UniqueValueRatio
from dqengine.operators.histogram import Histogram, HistogramBinned
from dqengine.operators.scan import (
    ApproxCountDistinct,
    ApproxQuantile,
    ApproxQuantiles,
    Completeness,
    Compliance,
    Correlation,
    DataType,
    ExactQuantile,
    InterquartileRange,
    KLLParameters,
    KLLSketch,
    Kurtosis,
    Maximum,
    MaxLength,
    Mean,
    Minimum,
    MinLength,
    PatternMatch,
    Range,
    RatioOfSums,
    Size,
    Skewness,
    StandardDeviation,
    Sum,
    Variance,
    ZerosCount,
)
from dqengine.operators.special import AggregatedState, ColumnCount, ColumnExists, CustomAggregator, CustomSql, DatasetMatch

__all__ = [
    "AggregatedState", "AnalyzerOptions", "ApproxCountDistinct", "ApproxQuantile", "ApproxQuantiles", "ColumnCount", "ColumnExists", "Completeness", "Compliance", "Correlation",
    "CountDistinct", "CustomAggregator", "CustomSql", "DataType", "DatasetMatch", "Distinctness", "DuplicateRowCount", "Entropy", "ExactQuantile", "FilteredRow", "Histogram",
    "HistogramBinned", "InterquartileRange", "KLLParameters", "KLLSketch", "Kurtosis", "MaxLength", "Maximum", "Mean", "MinLength", "Minimum", "MutualInformation", "NullBehavior",
    "PatternMatch", "Range", "RatioOfSums", "Size", "Skewness", "StandardDeviation", "Sum", "UniqueValueRatio", "Uniqueness", "Variance", "ZerosCount",
]
