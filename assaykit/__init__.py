"""assaykit: evaluation analytics as Spark jobs.

Every public function takes DataFrames and returns a DataFrame.  Nothing here runs an
action unless its docstring says so (sinks, the cohort check, the two-key de-duplication
loop and the streaming jobs).
"""
