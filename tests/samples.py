"""Five records, one of each taxpayer type."""

RECORD_CSV = """Taxpayer Type,Tax Year,Transaction Date,Income Source,Deduction Type,State,Income,Deductions,Taxable Income,Tax Rate,Tax Owed
Trust,2019,2019-11-02,Rental,Medical Expenses,OH,82000,7000,75000,0.18,13500
Individual,2020,2020-05-21,Salary,Education Expenses,WA,64000,4000,60000,0.15,9000
Non-Profit,2022,2022-02-14,Investment,Charitable Contributions,GA,910000,110000,800000,0.10,80000
Corporation,2022,2022-09-30,Business Income,Business Expenses,TX,1250000,250000,1000000,0.25,250000
Partnership,2023,2023-12-05,Capital Gains,Mortgage Interest,CA,430000,30000,400000,0.30,120000
"""
