"""The registered queries of this folder and the SQL that checks them."""

from __future__ import annotations

from .bpe import op6_bpe
from .exact_dedup import OP5_SQL, op5_exact_dedup
from .fill_middle import OP13_SQL, op13_fill_middle
from .html_extract import op3_html_extract
from .language import op11_language_id
from .licenses import OP10_SQL, op10_license_scan
from .mixing import op1_mixing
from .near_dedup import op7_near_dedup
from .neighbours import op8_neighbours
from .quality import op2_quality
from .secrets import op4_secret_scan
from .sharding import op9_sharding
from .valid_time import OP12_SQL, op12_valid_time

QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_quality": op2_quality,
    "op3_html_extract": op3_html_extract,
    "op4_secret_scan": op4_secret_scan,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_bpe": op6_bpe,
    "op7_near_dedup": op7_near_dedup,
    "op8_neighbours": op8_neighbours,
    "op9_sharding": op9_sharding,
    "op10_license_scan": op10_license_scan,
    "op11_language_id": op11_language_id,
    "op12_valid_time": op12_valid_time,
    "op13_fill_middle": op13_fill_middle,
}
SQL = {"op5_exact_dedup": OP5_SQL, "op10_license_scan": OP10_SQL, "op12_valid_time": OP12_SQL, "op13_fill_middle": OP13_SQL}
