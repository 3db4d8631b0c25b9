"""Count-based text analytics on Spark DataFrames."""

from wordloom.functions.text import sentence_tokens, tokens_v1, tokens_v2
from wordloom.operators.cooc import PairParams, count_pairs
from wordloom.operators.evaluate import Embedding
from wordloom.plans.workspace import Workspace

__all__ = ["Embedding", "PairParams", "Workspace", "count_pairs", "sentence_tokens", "tokens_v1", "tokens_v2"]
