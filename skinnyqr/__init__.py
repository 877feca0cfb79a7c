"""skinnyqr: tall-and-skinny matrix analytics on Spark DataFrames.

Matrices are ordinary DataFrames:

* dense rows   ``(row_id BIGINT, v ARRAY<DOUBLE>)``
* sparse cells ``(user_id BIGINT, item_id BIGINT, rating DOUBLE)``

The public operators are a numerically stable QR factorisation
(R only, or Q and R, with a tunable reduction tree), a stochastic SVD
built on it, and an item-based collaborative-filtering recommender
that scores users against items from the factors.
"""

from skinnyqr.operators.tsqr import (
    QRResult,
    combine_r,
    qr_residual,
    r_cells,
    tall_skinny_qr,
    tall_skinny_r,
)
from skinnyqr.operators.ssvd import (
    SSVDResult,
    at_times_q,
    dense_at_times_q,
    dense_projection,
    gram_matrix,
    random_projection,
    stochastic_svd,
    stochastic_svd_dense,
)
from skinnyqr.operators.recommend import (
    recommend,
    recommend_split,
    score_pairs,
)
from skinnyqr.operators.topn import merge_topn, top_n

__all__ = [
    "QRResult",
    "SSVDResult",
    "at_times_q",
    "combine_r",
    "dense_at_times_q",
    "dense_projection",
    "gram_matrix",
    "merge_topn",
    "qr_residual",
    "r_cells",
    "random_projection",
    "recommend",
    "recommend_split",
    "score_pairs",
    "stochastic_svd",
    "stochastic_svd_dense",
    "tall_skinny_qr",
    "tall_skinny_r",
    "top_n",
]
