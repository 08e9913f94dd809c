"""Fleet database telemetry analytics on PySpark.

Every operator is a function from DataFrames to a DataFrame. ``functions`` holds column expressions,
``operators`` the table jobs, ``plans`` configuration and change planning, ``sources`` readers and writers,
``streaming`` the stateful jobs and ``registry`` the binding of all of them to the test tables.
"""
