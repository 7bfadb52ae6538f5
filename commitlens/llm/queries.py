"""Imports every query module, so that the register is complete."""

from commitlens.llm import q_bpe, q_html, q_licenses, q_lines, q_merkle, q_mixing, q_phrases, q_pieces, q_quality, q_simhash, q_substrings, q_urls, q_vectors  # noqa: F401
from commitlens.llm.register import ORACLE, QUERIES  # noqa: F401
