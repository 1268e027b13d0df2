"""Every registered query beside its SQL twin on the smallest tables; some of each module with INKSPAN_SHORT=1.

The queries are small jobs that leave most cores idle, so four run at a time; each test looks at one result.
"""

import os
from concurrent.futures import ThreadPoolExecutor

import oracle_check as oc
import pytest

from inkspan.plans import catalog

SF = "/root/testdata/sf0.001"
FAST = """spacing scanline_extents polygon_runs bounds tokenize missing_glyphs mirror_plan library_documents fresh_photos photo_usage dominant_color
surface_tolerance label_borders distance_within solid_width pick_disjoint rank_inks top_guesses nearest_label boundary_sharpness""".split()
NAMES = FAST if os.environ.get("INKSPAN_SHORT") else sorted(catalog.oracle_sql())


@pytest.fixture(scope="module")
def results(spark, request):
    con, queries, twins = oc.connect(SF), catalog.queries(), catalog.oracle_sql()
    wanted = [i.callspec.params["name"] for i in request.session.items if i.fspath == request.node.fspath]

    def run(name):
        try:
            return oc.compare(spark, con.cursor(), name, queries[name], twins[name], SF)
        except Exception as e:  # a test reports it
            return False, f"{name}: {type(e).__name__} {str(e)[:900]}"

    with ThreadPoolExecutor(4) as pool:
        return dict(zip(wanted, pool.map(run, wanted), strict=True))


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(results, name):
    ok, said = results[name]
    assert ok, said
