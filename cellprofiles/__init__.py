"""Image-based cell profiling as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Executors get the functions they run with the task, so they need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from .operators.assign import assign_patients
from .operators.cells import (
    build_single_cell_parquet,
    canonical_single_cells,
    joined_feature_columns,
    to_canonical_single_cells,
)
from .operators.evaluate import (
    batch_mixing,
    benchmark,
    benchmark_from_path,
    chance_level,
    label_classifiability,
    replicate_reproducibility,
    silhouette,
)
from .operators.features import select_features
from .operators.integrate import integrate_multiomics
from .operators.profile import (
    aggregate_to_wells,
    consensus_profiles,
    normalize_profiles,
)
from .operators.qc import (
    cell_count_summary,
    detect_outliers,
    feature_drift,
    missingness,
    top_drift,
)
from .operators.select import (
    attach_patient_metadata,
    cell_counts,
    feature_frame,
    hierarchy_summary,
    metadata_frame,
    select_disease_groups,
    select_patients,
)
from .operators.sites import (
    build_dev_subset,
    canonicalize_image_table,
    validate_image_table,
)
from .plans.jobs import (
    JobConfig,
    build_patient_profiles,
    prepare_dev_subset,
    qc_report,
    run_from_subset,
    run_profile_job,
)
from .schema import (
    CHANNELS,
    COMPARTMENTS,
    DISEASE_GROUPS,
    METADATA_PREFIX,
    SchemaValidationError,
    cast_to_schema,
    clinical_schema,
    feature_name,
    image_schema,
    partition_columns,
    patient_schema,
    profile_schema,
    require_schema,
    single_cell_schema,
    snrna_summary_schema,
    validate_schema,
)
from .session import build_session
from .sources.compartments import (
    convert_compartment_csvs,
    join_compartments,
    read_compartment_csvs,
    write_compartment_csvs,
)
from .sources.tables import (
    load_metadata_csvs,
    load_single_cells,
    read_csv,
    read_parquet,
    write_parquet,
)
