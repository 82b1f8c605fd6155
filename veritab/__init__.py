"""Data-quality analytics on Spark: checks, evidence, profiles and run history."""

from veritab.model import Check
from veritab.plans.suite import run_check, run_suite, violations

__all__ = ["Check", "run_check", "run_suite", "violations"]
