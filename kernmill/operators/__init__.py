"""DataFrame operators: kernel sums, neighbours, hashing estimators, clustering, sampling."""
