"""All queries and their SQL. Workers import single modules of plans, so that none of those may import this one."""

from quillon.plans import decoding, documents, evaluation, images, layout, media, text, tokenizers, vectors  # noqa: F401
from quillon.plans.registry import ORACLES, QUERIES  # noqa: F401
