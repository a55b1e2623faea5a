"""FX2 scoring row, risk edges, prediction statistics, a trained pipeline end to end."""

import pytest
from pyspark.sql import functions as F

from embercast import fixed
from embercast.functions import risk
from embercast.operators import scoring, stats, train
from embercast.sources import files

FX2 = dict(temp_2m_mean=27.5, temp_2m_max=33.0, temp_2m_min=18.5, relative_humidity_mean=42.0,
           relative_humidity_min=25.0, relative_humidity_max=70.0, soil_moisture_7_28cm=.18,
           soil_moisture_28_100cm=.21, soil_temp_100_255cm=19.4, direct_shortwave_radiation=4200.0,
           evapotranspiration=4.8, vapor_pressure_deficit=2.4, cloud_cover_high=18.0, precipitation_sum=.6,
           wind_speed_mean=12.0, wind_speed_max=28.0, surface_pressure=910.0, dew_point=11.0,
           radiation_diffuse=140.0, temperature_range=14.5, humidity_range=45.0, day_of_year=210.0, month=7.0,
           is_dry_season=1.0)


def test_required_columns(spark):
    df = spark.createDataFrame([tuple(FX2.values())], ", ".join(f"{k} double" for k in FX2))
    assert files.require_columns(df).columns == fixed.SCORING_FEATURES
    with pytest.raises(ValueError) as e:
        files.require_columns(df.select("temp_2m_mean"))
    missing = sorted(set(fixed.SCORING_FEATURES) - {"temp_2m_mean"})
    assert str(missing) in str(e.value)
    assert FX2["temp_2m_max"] - FX2["temp_2m_min"] == FX2["temperature_range"]
    assert FX2["relative_humidity_max"] - FX2["relative_humidity_min"] == FX2["humidity_range"]


def test_risk_edges(spark):
    df = spark.createDataFrame([(0.2499,), (0.25,), (0.50,), (0.75,), (None,), (0.2999,), (0.30,), (0.60,)], "p double")
    out = [(r[0], r[1], r[2]) for r in df.select("p", risk.risk_level4("p"), risk.risk_level3("p")).collect()]
    assert [o[1] for o in out[:5]] == ["bajo", "medio", "alto", "critico", "desconocido"]
    assert [o[2] for o in out[5:]] == ["BAJO", "MEDIO", "ALTO"]
    assert df.select(risk.risk_level4("p", upper=True)).first()[0] == "BAJO"


def test_prediction_stats_one_record(spark):
    r = scoring.prediction_stats(spark.createDataFrame([(1,)], "prediction int")).first()
    assert (r.total_predictions, r.n_incendio, r.most_common_prediction) == (1, 1, "incendio")


def test_pipeline_scores_and_bands(spark):
    rows = [tuple(float(v) + (i % 5) for v in FX2.values()) + (i % 2,) for i in range(40)]
    df = spark.createDataFrame(rows, ", ".join(f"{k} double" for k in FX2) + ", incendio int")
    model = train.train_forest(df, fixed.SCORING_FEATURES, "incendio", num_trees=5, max_depth=3, seed=1)
    out = scoring.batch_score(model, df.limit(2))
    assert out.count() == 2 and "risk_level" in out.columns
    assert set(out.columns) >= {"prediction", "prediction_label", "probability_fire", "risk_level"}
    bands = stats.risk_bands(scoring.batch_score(model, df)).first()
    assert bands.high + bands.medium + bands.low == bands.total == 40
    imp = train.feature_importance(model, top=5).collect()
    assert len(imp) == 5 and imp[0].feature in fixed.SCORING_FEATURES


def test_alert_needs_fire_class(spark):
    df = spark.createDataFrame([(0.9, 1), (0.9, 0), (0.5, 1), (None, 1)], "p double, c int")
    assert [r[0] for r in df.select(risk.is_alert("p", "c", 0.7)).collect()] == [True, False, False, False]


def test_advice_lookup(spark):
    df = spark.createDataFrame([("ALTO",), ("bajo",)], "risk_level string")
    got = {r.risk_level: r.heading for r in scoring.with_advice(df).collect()}
    assert got == {"ALTO": "ALERTA DE ALTO RIESGO", "bajo": "CONDICIONES FAVORABLES"}
    assert df.select(F.lit(1)).count() == 2


def test_risk_bands_on_class_code(spark):
    codes = spark.createDataFrame([(0,), (1,), (2,), (3,), (4,)], "c int")
    r = stats.risk_bands(codes, code_col="c").first()
    assert (r.total, r.high, r.medium, r.low) == (5, 2, 1, 2)


class ConstantModel:
    """Stand-in scorer that always answers P = [0.2, 0.8] (class 1)."""

    def transform(self, df):
        from pyspark.ml.functions import array_to_vector
        return df.withColumn("probability", array_to_vector(F.array(F.lit(0.2), F.lit(0.8)))) \
                 .withColumn("prediction", F.lit(1.0))


def test_constant_model_details_and_batch(spark):
    df = spark.createDataFrame([tuple(FX2.values())] * 2, ", ".join(f"{k} double" for k in FX2))
    r = scoring.score_with_details(ConstantModel(), df.limit(1)).first()
    assert (r.prediction, r.prediction_label, r.risk_level) == (1, "incendio", "critico")
    assert abs(r.probability_fire - 0.8) < 1e-12 and r.timestamp is not None
    batch = scoring.batch_score(ConstantModel(), df)
    assert batch.count() == 2 and "risk_level" in batch.columns
    p = scoring.predict_proba(ConstantModel(), df).first()
    assert abs(p.probability_no_fire + p.probability_fire - 1.0) < 1e-9
    assert [x.prediction for x in scoring.predict(ConstantModel(), df).collect()] == [1, 1]


def test_numeric_columns_types(spark):
    from embercast.functions import numeric_columns
    df = spark.createDataFrame([(1, 0.5, "x", True)], "a int, b double, s string, f boolean")
    assert numeric_columns(df) == ["a", "b"]


def test_forest_is_reproducible_with_fixed_layout(spark):
    rows = [(i % 9, float(i % 17), float((i * 7) % 23), int((i * 7) % 23 > 11)) for i in range(300)]
    df = spark.createDataFrame(rows, "site_id int, a double, b double, incendio int")

    def probs(frame):
        m = train.train_forest(train.fixed_layout(frame, "site_id", 4), ["a", "b"], "incendio",
                               num_trees=8, max_depth=4, seed=7)
        return sorted(r.probability_fire for r in scoring.batch_score(m, df).collect())

    assert probs(df) == probs(df.repartition(5))  # same seed + same layout -> same model
