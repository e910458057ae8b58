import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from leakframe.session import configure  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoint")))
    return configure(session)


@pytest.fixture
def rules():
    from leakframe.operators.rules import Rule

    return [
        Rule("aws", "AWS Access Key", r"AKIA[A-Z0-9]{16}", "aws_access_key", "critical", ord=1),
        Rule("github", "GitHub Token", r"ghp_[a-zA-Z0-9]{36}", "github_token", "critical", ord=2),
        Rule("api", "Generic API Key", r"sk_live_[a-zA-Z0-9]{20,}", "api_key", "high", ord=3),
    ]
