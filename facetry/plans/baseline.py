"""The linear baseline as one job: clean, composite label, ridge, residual SVD, save."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetry.functions.text import COMPOSITE_SEPARATOR
from facetry.operators.clean import add_composite, clean_items
from facetry.operators.projection import vector_width
from facetry.operators.ridge import Ridge, fit_ridge
from facetry.session import clear_scratch, ship_package, stage
from facetry.sources.readers import load_items, load_vectors
from facetry.sources.writers import save_json, save_table


def save_ridge(scored: DataFrame, fit: Ridge, item_id: str, output_dir: str) -> dict[str, str]:
    spark, root = scored.sparkSession, f"{output_dir.rstrip('/')}/baselines/linear"
    width = len(fit.intercept)
    config = {
        "alpha": fit.alpha, "n_nuisance_dims": len(fit.spectrum.values), "n_samples": fit.n, "embedding_dim": width,
        "n_categories": fit.sizes, "design_matrix_cols": sum(fit.sizes.values()),
        "explained_variance_ratio": fit.explained_variance_ratio.tolist(),
        "singular_values": fit.spectrum.values.tolist(), "residual_variance_ratio": fit.residual_variance_ratio,
    }
    return {
        "attribute_embedding": save_table(scored.select(item_id, F.col("fitted").alias("embedding")), f"{root}/linear_attribute_embedding"),
        "nuisance": save_table(scored.select(item_id, F.col("nuisance").alias("embedding")), f"{root}/linear_nuisance"),
        "coefficients": save_table(fit.coefficient_frame(spark), f"{root}/ridge_coefficients"),
        "config": save_json(spark, config, f"{root}/linear_config"),
    }


def run_baseline(
    items: DataFrame, vectors: DataFrame, order_col: str, text_col: str, composite_cols: list[str], plain_col: str,
    output_dir: str, alpha: float = 1.0, n_nuisance_dims: int = 5,
) -> tuple[Ridge, dict[str, str]]:
    """``order_col`` is the item id, which ``vectors`` shares."""
    cleaned = clean_items(items, order_col, text_col, create_id=False)
    labelled = add_composite(cleaned, composite_cols, "composite", COMPOSITE_SEPARATOR).select(order_col, "composite", F.col(plain_col).alias("plain"))
    known = vectors.select(order_col, *[c for c in vectors.columns if c not in labelled.columns])
    rows = stage(labelled.join(known, order_col, "left"), "baseline-rows")  # items without a vector come out with nulls
    columns = {"composite": "composite", "plain": "plain"}
    fit = fit_ridge(rows, columns, "embedding", vector_width(rows, "embedding"), alpha, n_nuisance_dims, spread_by=order_col)
    scored = fit.score(rows, columns, "embedding", spread_by=order_col)
    return fit, save_ridge(scored, fit, order_col, output_dir)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description="Linear baseline")
    parser.add_argument("--data", required=True)
    parser.add_argument("--embeddings", required=True)
    parser.add_argument("--id-col", required=True)
    parser.add_argument("--description-col", default="description")
    parser.add_argument("--composite", nargs="+", default=["country", "province"])
    parser.add_argument("--plain", default="variety")
    parser.add_argument("--output-dir", required=True)
    parser.add_argument("--alpha", type=float, default=1.0)
    parser.add_argument("--n-nuisance-dims", type=int, default=5)
    a = parser.parse_args(argv)
    spark = SparkSession.builder.appName("facetry-linear-baseline").getOrCreate()
    ship_package(spark)
    try:
        run_baseline(load_items(spark, a.data), load_vectors(spark, a.embeddings), a.id_col, a.description_col,
                     a.composite, a.plain, a.output_dir, a.alpha, a.n_nuisance_dims)
    finally:
        clear_scratch(spark)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
