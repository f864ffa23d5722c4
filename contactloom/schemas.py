"""Schemas of the relations that the operators take and give."""

from __future__ import annotations

CHROMS = "chr_idx int, name string, length long"
CONTACTS = "resolution int, chr1 int, bin1 int, chr2 int, bin2 int, cnt float"
NORM_VEC = "norm string, resolution int, chr_idx int, bin int, value double"
EXPECTED = "norm string, resolution int, chr_idx int, dist int, value double"
TRACK = "track_id string, chr_idx int, x1 int, x2 int, cluster_id int, cluster_name string"
BIN_MAP = "chr_idx int, bin int, proto int, row_id long"
CELLS = "row_id long, col_id int, v double"
COL_WEIGHTS = "col_id int, w long"
