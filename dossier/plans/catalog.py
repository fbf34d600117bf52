"""Importing this module fills the catalogue."""

from dossier.plans import q_evaluation, q_evidence, q_layout, q_records, q_retrieval, q_text  # noqa: F401
from dossier.plans.registry import CATALOGUE

__all__ = ["CATALOGUE"]
