"""Present values, returns and Black-Scholes prices on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from helioscope.functions.special import normal_cdf


def present_value(amount: Column, rate: Column, periods: Column) -> Column:
    return amount / F.pow(1 + rate, periods)


def future_value(amount: Column, rate: Column, periods: Column) -> Column:
    return amount * F.pow(1 + rate, periods)


def simple_return(continuous: Column) -> Column:
    return F.exp(continuous) - 1


def continuous_return(simple: Column) -> Column:
    return F.ln(1 + simple)


def d1(spot: Column, strike: Column, rate: Column, sigma: Column, years: Column) -> Column:
    return (F.ln(spot / strike) + (rate + sigma * sigma / 2) * years) / (sigma * F.sqrt(years))


def d2(spot: Column, strike: Column, rate: Column, sigma: Column, years: Column) -> Column:
    return d1(spot, strike, rate, sigma, years) - sigma * F.sqrt(years)


def black_scholes(spot: Column, strike: Column, rate: Column, sigma: Column, years: Column, call: bool = True) -> Column:
    a, b = d1(spot, strike, rate, sigma, years), d2(spot, strike, rate, sigma, years)
    if call:
        return spot * normal_cdf(a) - strike * F.exp(-rate * years) * normal_cdf(b)
    return strike * F.exp(-rate * years) * normal_cdf(-b) - spot * normal_cdf(-a)
