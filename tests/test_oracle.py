"""Queries beside their DuckDB oracle; set GRIDWEAVE_ALL=1 to run every one."""

import os

import pytest

import gridweave.plans.catalog  # noqa: F401
from gridweave.plans import check, registry

SF = os.environ.get("GRIDWEAVE_SF", "/root/testdata/sf0.001")
SOME = """grid_to_pixels rle_decode tile_features tile_label edge_class style_latent stratify split_exact training_slice extract_palette
quantize_weighted resample tile_slice_dedup adjacency variant_group_expand adjacency_degree completeness missing_tiles map_features
path_check pin_expand autotile_index archive_merge fb_stats fb_preferred_style fb_stream_stats bm25_search kg_expand v_template v_theme
sprite_frames variants_noise meta_label lm_grid_parse read_pairs merge_splits""".split()


@pytest.fixture(scope="module")
def con():
    return check.connect(SF)


@pytest.mark.parametrize("name", sorted(registry.QUERIES) if os.environ.get("GRIDWEAVE_ALL") else SOME)
def test_matches_oracle(spark, con, name):
    ok, msg = check.compare(spark, con, SF, name, registry.QUERIES[name], registry.ORACLES.get(name))
    assert ok, msg
