"""stallscope: incident analytics on Spark DataFrames.

Three families of jobs, each over any number of cases or services at once:

* thread dumps  -> thread rows -> dump signals -> case signals -> findings
* thread rows   -> filter / dedup / group-count / top
* access logs   -> cache-miss metrics -> ranked hypotheses -> reports
"""
