"""Session settings and the checkpoint folder."""

import pytest

from jurybox.session import SETTINGS, checkpoint_dir


def test_settings_are_valid(spark):
    session = spark.newSession()
    for key, value in SETTINGS.items():
        session.conf.set(key, value)
        assert session.conf.get(key) == value


def test_checkpoint_folder(spark, tmp_path):
    session = spark.newSession()
    named = session.conf.get("spark.checkpoint.dir", None)
    if named:  # what the cluster names comes first
        assert checkpoint_dir(session, str(tmp_path)) == named
    else:
        assert checkpoint_dir(session, str(tmp_path)) == str(tmp_path)
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            checkpoint_dir(session)
