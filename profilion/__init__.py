"""profilion: profile, run, track and layer analytics on Spark DataFrames."""
