"""DataFrame operators: joins, zonal statistics, series, focal, iterative and scoring."""
