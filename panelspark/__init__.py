"""Linear models with absorbed group effects on Spark DataFrames."""

from .api import PartialOut, fit, partial_out, reg
from .model import CoefTable, Model
from .operators.covariance import Cluster, Covariance, Robust, Simple
from .plans.design import Dummy
from .plans.formula import Formula, FormulaError, fe, fn, formula, has_fe, has_iv, iv, parse, parse_fixed_effects, var

__all__ = ["Cluster", "CoefTable", "Covariance", "Dummy", "Formula", "FormulaError", "Model", "PartialOut", "Robust", "Simple", "fe", "fit", "fn", "formula", "has_fe", "has_iv", "iv", "parse", "parse_fixed_effects", "partial_out", "reg", "var"]
