"""regcast — regression and forecasting workflows as Spark jobs.

Typical use::

    from regcast import PipelineConfig, ModelSpec, TrainingConfig, train, predict
    cfg = PipelineConfig(("p_size", "p_type"), "p_retailprice", ("p_partkey",), model=ModelSpec("ridge"))
    result = train(df, TrainingConfig(cfg, "Last percent", 80), test_df)
"""

from .functions.checks import validate_feature_data, validate_labeled_data, validate_series
from .functions.metrics import calculate_metrics, long_form, metrics_frame, prediction_frame
from .functions.profile import override_plan, preprocessing_plan, transformed_feature_count
from .operators.autocorr import acf_values, correlation_table, pacf_values, select_lags
from .operators.feature_selection import select_k_best
from .operators.lags import lookback_features, windows, with_lags
from .operators.models import REGISTRY, fit_model
from .operators.rowindex import Indexed, with_row_index
from .plans.config import FeatureSelection, ModelSpec, PipelineConfig, TrainingConfig, ValidationConfig
from .plans.workflows import predict, train, validate
from .session import ensure_checkpoint_dir, local_session, ship_package
from .sources.artifacts import deserialize_artifact, load_artifact, save_artifact, serialize_artifact
from .sources.tables import read_table, write_predictions
from .streaming.scoring import score_stream

__all__ = [name for name in dir() if not name.startswith("_")]
