"""The declarative rule language: Rules = [ IsComplete "id", RowCount > 10 ]."""

from dqengine.rules.evaluate import EvaluateDataQuality
from dqengine.rules.parser import ParsingError, Rule, Ruleset, parse

__all__ = ["EvaluateDataQuality", "ParsingError", "Rule", "Ruleset", "parse"]
