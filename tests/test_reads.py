import os

import pytest
from pyspark.sql import functions as F

from quantloom.operators import glyco, reads


def test_main_score_and_columns(rows):
    df = rows("Var_A double, VAR_B double, precursor_charge int", [(1.0, 2.0, 3)])
    assert reads.designate_main(df, "var_a").columns == ["main_var_a", "var_b", "precursor_charge"]
    assert reads.promote_counts(df).columns[-1] == "var_precursor_charge"
    with pytest.raises(ValueError):
        reads.designate_main(df, "var_c")
    everything = rows(", ".join(f"{c} double" for c in reads.PRETRAINED), [tuple([1.0] * len(reads.PRETRAINED))])
    assert abs(reads.designate_main(everything, "swath_pretrained").first().main_var_pretrained - sum(reads.PRETRAINED.values())) < 1e-12
    columns = ["main_x", "var_x", "var_intensity_score", "y"]
    assert reads.score_columns(columns, "main_x") == ["main_x", "var_x", "var_intensity_score"]
    assert reads.score_columns(columns, "main_var_x", ["var_x", "var_intensity_score"]) == ["main_var_x", "var_intensity_score"]
    with pytest.raises(ValueError):
        reads.score_columns(columns, "main_x", "metabolomics")


@pytest.mark.parametrize(("path", "name"), [("/a/b.c/run1.mzML.gz", "run1.mzML"), ("run2", "run2"), (".hidden", ".hidden"), ("C:\\x\\y.raw", "y"), ("", ""), (None, None)])
def test_base_name(rows, path, name):
    if path and "\\" not in path:
        assert os.path.splitext(os.path.basename(path))[0] == name
    assert rows("p string", [(path,)]).select(reads.base_name(F.col("p"))).first()[0] == name


def test_alignment(rows):
    alignment = rows("alignment_id int, precursor_id int, reference_feature_id long, aligned_feature_id long, label int", [(1, 5, 10, 11, 1), (1, 5, 10, 12, 1), (2, 5, 20, 20, 1), (3, 6, 30, 31, -1), (3, 6, 30, 32, None)])
    scores = rows("feature_id long, score double, pep double, qvalue double", [(10, 1.0, 0.1, 0.2), (11, 1.0, 0.9, 0.2), (12, 2.0, 0.2, 0.3), (12, 3.0, 0.05, 0.1), (12, 9.0, 0.01, None)])
    got = [(r.alignment_group_id, r.feature_id, r.feature_type, r.place, r.pep) for r in reads.alignment_groups(alignment, scores, 0.5).orderBy("place").collect()]
    assert got == [(1, 10, "REFERENCE", 1, 0.1), (1, 12, "QUERY", 2, 0.01)]
    told = {r.feature_id: (r.decoy, r.qvalue) for r in reads.alignment_features(alignment, scores).collect()}
    assert told == {11: (0, 0.2), 12: (0, 0.1), 20: (0, None), 31: (1, None), 32: (None, None)}
    assert reads.alignment_groups(alignment.limit(0), scores, 0.5).count() == 0


def test_ipf_variants_need_what_they_use(rows):
    features = rows("id long, precursor_id long", [(1, 7), (1, 7), (2, 7), (3, 8), (None, 7)])
    precursors = rows("id long, decoy int", [(7, 0), (7, 0), (8, 1)])
    ms2 = rows("feature_id long, pep double", [(1, 0.1), (2, 0.6), (3, 0.1), (None, 0.1)])
    ms1 = rows("feature_id long, pep double", [(1, 0.3)])
    read = lambda **k: [tuple(r) for r in reads.ipf_precursors(features, precursors, ms2, 0.5, **k).collect()]
    assert read() == [(1, 0.1, None, None)] and read(score_ms1=ms1) == [(1, 0.1, 0.3, None)]
    assert read(score_transition=rows("feature_id long, transition_id long, pep double", [(1, 4, 0.2), (1, 5, 0.9)]), transitions=rows("id long, type string, decoy int", [(4, "", 0), (5, "y", 0)])) == [(1, 0.1, None, 0.2)]
    assert read(intensities=rows("feature_id long, area_intensity double", [])) == []


def test_samples_and_weights(rows):
    df = rows("k int, decoy int", [(i, int(i % 4 == 0)) for i in range(100)])
    some = reads.stratified_sample(df, "decoy", "k", 20).collect()
    assert sorted(r.decoy for r in some) == [0] * 15 + [1] * 5 and reads.stratified_sample(df, "decoy", "k", 1000).count() == 100
    assert reads.first_by_hash(df, "k", 7).collect() == reads.first_by_hash(df.repartition(5), "k", 7).collect()
    got = {r.pep: r.fdr for r in glyco.weighted_fdr(rows("pep double, w double", [(0.1, 1.0), (0.5, 3.0), (0.5, 0.0), (None, 1.0)]), "pep", "w").collect()}
    assert got == {0.1: 0.1, 0.5: pytest.approx(1.6 / 4), None: None}
